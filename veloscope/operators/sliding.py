"""Sliding frames (t - w, t] for keys of any size (C6-C9, M1): no task holds a key, a window's width or a frame.

``look_back`` gives running totals at a time and at the last time up to t - w: windows inside (key, range partition), whose frames only grow,
plus the totals of the key's earlier partitions. Only the frames that begin before their partition are asked for, by one running count over the keys
that lie in several partitions.

``sliding_aggregates`` (count, sum, largest): rows of one time become one, so times of a key are distinct; their positions and the
first position of every frame come from ``look_back``. Positions are cut into blocks of ``BLOCK``. A frame is the part
inside its last block (a window over that block), the rest of its first block from the first position on (running
aggregates from each block's end) and the blocks between, as the few aligned runs of 1, 2, 4 ... blocks that cover them. Parts are only
added or compared, never subtracted, so NaN, infinities and amounts of any size give what a plain window gives.

``sliding_distinct``: a value seen at t counts until t + w. The intervals [t, t + w) of a (key, value) that touch become one. The
distinct values of a frame are the intervals that began up to t less those that ended: whose last value was seen up to t - w.

Keys and times are non-null; null values are not counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloscope.operators.prefix import PART, range_parts, running_sums
from veloscope.session import written_once

BLOCK = 1024


def _both(*, n: str, s: str, m: str, prefix: str = "") -> list[Column]:
    return [F.sum(n).alias(f"{prefix}n"), F.sum(s).alias(f"{prefix}s"), F.max(m).alias(f"{prefix}m")]


def _bounds(d: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A row per range partition of ``d`` (sorted by ``cols``): the last row before it and the first one after it."""
    row, w = F.struct(*cols), Window.orderBy(PART)
    return d.groupBy(PART).agg(F.min(row).alias("_a"), F.max(row).alias("_z")) \
        .select(F.col(PART).alias("_bp"), F.lag("_z").over(w).alias("_before"), F.lead("_a").over(w).alias("_after"))


def look_back(times: DataFrame, key: str, at: str, widths: dict[str, int], own: Sequence[str], upto: dict[str, Sequence[str]]) -> DataFrame:
    """``times`` (distinct per key) with ``run_<c>``, the running total of each column in ``own`` (whole numbers), and per width w
    ``<c>_to_<w>``: the total of each column in ``upto[w]`` over the key's times up to ``at`` - w."""
    cols = list(dict.fromkeys([*own, *(c for w in widths for c in upto[w])]))
    d = range_parts(times, [key], [F.col(at)])
    earlier = Window.partitionBy("_gk").orderBy("_gp").rowsBetween(Window.unboundedPreceding, -1)
    total = d.groupBy(F.col(key).alias("_gk"), F.col(PART).alias("_gp")).agg(*[F.sum(c).alias(f"_b_{c}") for c in cols])
    # one key of a partition at most began in an earlier one: a row per partition
    spans = written_once(total.select("_gk", "_gp", F.lit(True).alias("_span"), F.row_number().over(Window.partitionBy("_gk").orderBy("_gp")).alias("_nth"),
                                      *[F.sum(f"_b_{c}").over(earlier).alias(f"_o_{c}") for c in cols]).where("_nth > 1").drop("_nth"), "spans")
    w_in = Window.partitionBy(key, PART).orderBy(at)
    run = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = {w: w_in.rangeBetween(Window.unboundedPreceding, -us) for w, us in widths.items()}
    r = d.withColumns({**{f"run_{c}": F.sum(c).over(run) for c in own},
                       **{f"{c}_to_{w}": F.sum(c).over(before[w]) for w in widths for c in upto[w]},
                       **{f"_in_{w}": F.count(F.lit(1)).over(before[w]) > 0 for w in widths}})
    r = written_once(r.join(F.broadcast(spans), (F.col(key) == F.col("_gk")) & (F.col(PART) == F.col("_gp")), "left"), "running")
    one = r.where("_span IS NULL").select(*times.columns, *[f"run_{c}" for c in own],
                                          *[F.coalesce(f"{c}_to_{w}", F.lit(0)).alias(f"{c}_to_{w}") for w in widths for c in upto[w]])
    # frames that begin before their partition: the running totals of their keys, read at the frames' ends
    none, long = F.lit(None).cast("string"), F.lit(None).cast("long")
    held = r.join(F.broadcast(spans.select(F.col("_gk").alias("_k")).distinct()), F.col(key) == F.col("_k"), "left_semi")
    data = held.select(key, at, F.lit(0).alias("_side"), none.alias("_w"), long.alias("_q"), *cols)
    ends = F.array(*[F.struct(F.lit(w).alias("w"), (F.col(at) - us).alias("t"), F.col(f"_in_{w}").alias("known")) for w, us in widths.items()])
    ask = r.where("_span").select(key, F.col(at).alias("_q"), F.explode(ends).alias("_e")).where("NOT _e.known") \
        .select(key, F.col("_e.t").alias(at), F.lit(1).alias("_side"), F.col("_e.w").alias("_w"), "_q", *[F.lit(0).cast("long").alias(c) for c in cols])
    got = running_sums(data.unionByName(ask), [key], at, cols, tiebreak=["_side"]).where("_side = 1").groupBy(F.col(key).alias("_k"), "_q").agg(
        *[F.max(F.when(F.col("_w") == w, F.col(f"run_{c}"))).alias(f"_x_{c}_{w}") for w in widths for c in upto[w]])
    got = written_once(got, "answers")
    more = r.where("_span").join(got, (F.col(key) == F.col("_k")) & (F.col(at) == F.col("_q")), "left").select(
        *times.columns, *[(F.col(f"run_{c}") + F.col(f"_o_{c}")).alias(f"run_{c}") for c in own],
        *[F.when(F.col(f"_in_{w}"), F.col(f"{c}_to_{w}") + F.col(f"_o_{c}")).otherwise(F.col(f"_x_{c}_{w}")).alias(f"{c}_to_{w}")
          for w in widths for c in upto[w]])
    return one.unionByName(more)


def _runs(first: Column, end: Column) -> Column:
    """The aligned runs (level, index) of 2^level blocks that cover the blocks first .. end - 1: two a level at most."""
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(end - first, F.lit(1)))).cast("int"))

    def of(level):
        step = F.pow(F.lit(2.0), level)
        a, z = F.ceil(first / step).cast("long"), F.floor(end / step).cast("long")
        one = lambda odd, i: F.when((a < z) & (odd % 2 == 1), F.struct(level.alias("level"), i.alias("i")))
        return F.array(one(a, a), one(z, z - 1))

    return F.filter(F.flatten(F.transform(levels, of)), lambda x: x.isNotNull())


def sliding_aggregates(df: DataFrame, key: str, at: str, widths: dict[str, int], value: str) -> DataFrame:
    """(key, at, first, prev, and n_<w>, s_<w>, m_<w> per width): count, sum and largest ``value`` of the rows in (at - w, at],
    the key's first time and the time before ``at``; a row per key and time."""
    return sliding(df, key, at, widths, value)


def sliding_distinct(df: DataFrame, key: str, value: str, at: str, widths: dict[str, int], name: str = "d") -> DataFrame:
    """(key, at, <name>_<w> per width): the distinct values of the rows in (at - w, at]; a row per key and time."""
    return sliding(df, key, at, widths, None, ((name, value),))


def sliding(df: DataFrame, key: str, at: str, widths: dict[str, int], value: str | None, distinct: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The columns of ``sliding_aggregates`` (of ``value``, if any) and of ``sliding_distinct`` for each (name, column), in one look-back."""
    times = df.groupBy(key, at).agg(*([F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.max(value).alias("m")] if value else []),
                                    F.lit(1).cast("long").alias("_one"))
    starts = {name: {w: f"_{name}_a_{w}" for w in widths} for name, _ in distinct}
    ends = {name: {w: f"_{name}_z_{w}" for w in widths} for name, _ in distinct}
    for name, column in distinct:
        s = _intervals(df, key, column, at, widths, starts[name], ends[name]).withColumnsRenamed({key: "_k", at: "_t"})
        flags = [*starts[name].values(), *ends[name].values()]
        times = times.join(s, (F.col(key) == F.col("_k")) & (F.col(at) == F.col("_t")), "left") \
            .select(*times.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in flags])
    keep = times.columns[:times.columns.index("_one")]
    t = look_back(times, key, at, widths, ["_one", *[c for x in starts.values() for c in x.values()]], {w: ["_one", *[x[w] for x in ends.values()]] for w in widths})
    counts = {f"{name}_{w}": F.col(f"run_{starts[name][w]}") - F.col(f"{ends[name][w]}_to_{w}") for name, _ in distinct for w in widths}
    if not value:
        return t.select(key, at, *[c.alias(k) for k, c in counts.items()])
    block = F.floor((F.col("pos") - 1) / BLOCK)
    t = t.select(*keep, F.col("run__one").alias("pos"), *[(F.col(f"_one_to_{w}") + 1).alias(f"lo_{w}") for w in widths], *[c.alias(k) for k, c in counts.items()])
    t = written_once(t.withColumn("blk", block), "times")
    w_in = Window.partitionBy(key, "blk").orderBy(at)
    back = Window.partitionBy(key, "blk").orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {f"{a}_{w}": f(a).over(w_in.rangeBetween(-us + 1, 0)) for w, us in widths.items() for a, f in (("n", F.sum), ("s", F.sum), ("m", F.max))}
    inside = t.withColumns({**cols, "_prev": F.lag(at).over(w_in)})
    whole = written_once(t.groupBy(key, "blk").agg(*_both(n="n", s="s", m="m"), F.min(at).alias("_min"), F.max(at).alias("_max")), "blocks")
    wb = Window.partitionBy(key).orderBy("blk")
    ends = whole.select(F.col(key).alias("_k"), F.col("blk").alias("_b"), F.lag("_max").over(wb).alias("_before"),
                        F.first("_min").over(wb).alias("first"))

    # frames that begin in an earlier block
    low = F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"lo_{w}").alias("lo")) for w in widths])
    wide = t.select(key, at, "blk", F.explode(low).alias("_e")).select(key, at, "blk", "_e.w", "_e.lo", F.floor((F.col("_e.lo") - 1) / BLOCK).alias("lo_blk")) \
        .where("lo_blk < blk")
    several = whole.where("blk > 0").select(F.col(key).alias("_k")).distinct()        # no frame of another key begins in an earlier block
    rest = t.join(several, F.col(key) == F.col("_k"), "left_semi").select(
        F.col(key).alias("_k"), F.col("pos").alias("_p"), F.sum("n").over(back).alias("r_n"), F.sum("s").over(back).alias("r_s"), F.max("m").over(back).alias("r_m"))
    level = F.floor(F.log2(F.max("blk").over(Window.partitionBy(key)) + 1)).cast("int")
    nodes = whole.withColumn("_top", level).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_top")))) \
        .groupBy(key, "level", F.floor(F.col("blk") / F.pow(F.lit(2.0), F.col("level"))).cast("long").alias("i")).agg(*_both(n="n", s="s", m="m"))
    spans = wide.where("blk - lo_blk > 1").select(key, "lo_blk", "blk").distinct()
    between = spans.withColumn("_r", F.explode(_runs(F.col("lo_blk") + 1, F.col("blk")))).select(key, "lo_blk", "blk", "_r.level", "_r.i") \
        .join(nodes, [key, "level", "i"]).groupBy(key, "lo_blk", "blk").agg(*_both(n="n", s="s", m="m", prefix="b_"))
    got = wide.join(rest, (F.col(key) == F.col("_k")) & (F.col("lo") == F.col("_p"))).drop("_k", "_p").join(between, [key, "lo_blk", "blk"], "left")
    got = got.groupBy(F.col(key).alias("_k2"), F.col(at).alias("_t2")).agg(
        *[F.max(F.when(F.col("w") == w, F.struct("r_n", "r_s", "r_m", "b_n", "b_s", "b_m"))).alias(f"_x_{w}") for w in widths])

    d = inside.join(got, (F.col(key) == F.col("_k2")) & (F.col(at) == F.col("_t2")), "left") \
        .join(ends, (F.col(key) == F.col("_k")) & (F.col("blk") == F.col("_b")))
    zero = F.lit(0)
    out = []
    for w in widths:
        x = lambda c: F.col(f"_x_{w}.{c}")  # noqa: E731, B023
        add = lambda a: sum((F.coalesce(x(f"{p}_{a}"), zero) for p in "rb"), F.coalesce(F.col(f"{a}_{w}"), zero))  # noqa: E731, B023
        out += [add("n").alias(f"n_{w}"), add("s").alias(f"s_{w}"), F.greatest(F.col(f"m_{w}"), x("r_m"), x("b_m")).alias(f"m_{w}")]
    return d.select(key, at, "first", F.coalesce("_prev", "_before").alias("prev"), *out, *counts)


def _intervals(df: DataFrame, key: str, value: str, at: str, widths: dict[str, int], starts: dict[str, str], ends: dict[str, str]) -> DataFrame:
    """(key, at, and per width): how many values' intervals start at ``at``, and how many have their last value there."""
    seen = range_parts(df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), at).distinct(), [key, "_v"], [F.col(at)])
    w = Window.partitionBy(key, "_v", PART).orderBy(at)
    d = seen.withColumns({"_prev": F.lag(at).over(w), "_next": F.lead(at).over(w)}) \
        .join(F.broadcast(_bounds(seen, [key, "_v", at])), F.col(PART) == F.col("_bp"))
    # of a (key, value) in several partitions, the row before or after is the bound of the next partition with rows
    beside = lambda c: F.when((F.col(f"{c}.{key}") == F.col(key)) & (F.col(f"{c}._v") == F.col("_v")), F.col(f"{c}.{at}"))
    t, prev, after = F.col(at), F.coalesce("_prev", beside("_before")), F.coalesce("_next", beside("_after"))
    far = lambda gap, us: F.coalesce(gap, F.lit(2**62)) >= us
    return d.groupBy(key, at).agg(*[F.count_if(far(t - prev, us)).alias(starts[w]) for w, us in widths.items()],
                                  *[F.count_if(far(after - t, us)).alias(ends[w]) for w, us in widths.items()])
