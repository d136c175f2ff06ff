"""Running totals over a large ordered group without a single-task sort.

``Window.partitionBy(g).orderBy(x)`` with a running frame sends every row of ``g`` to one task. When
a group can hold a large share of the data (one feature of a drift check, one model of an
evaluation, one hot user), the running total is computed over balanced range partitions instead:

1. rows are range-partitioned by (group, order, tie-break) -- the sampled bounds balance rows, not
   value ranges, and work for any orderable type -- and cut once, so that the partition number stays;
2. totals per (group, partition), at most partitions + groups rows, get their running offsets with a
   window over that small table;
3. a window inside (group, partition) adds the running total there.

The result equals the plain running window in (order, tie-break) order. Nulls of the order come last in
either direction; a null group is a group of its own (its rows stay).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloscope.session import cut_lineage

PART = "__part"


def ordered(order: str, descending: bool = False) -> Column:
    return F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()


def range_parts(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` range-partitioned by (by, order), with the partition number in ``PART``; materialised once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *[F.col(b).asc_nulls_last() for b in by], *order)
    return cut_lineage(d.withColumn(PART, F.spark_partition_id()))


def running_sums(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], descending: bool = False,
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Adds ``run_<s>`` (inclusive running sum of each ``s``) and ``tot_<s>`` (group total)."""
    by = list(by)
    keys = [ordered(order, descending), *[ordered(t) for t in tiebreak]]
    d = range_parts(df, by, keys)
    tot = d.groupBy(*by, PART).agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(f"_b_{s}") for s in sums])
    wg = Window.partitionBy(*(by or [F.lit(0)]))
    before = wg.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*[F.col(b).alias(f"_g_{b}") for b in by], F.col(PART).alias("_gp"),
                     *[F.coalesce(F.sum(f"_b_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
                     *[F.sum(f"_b_{s}").over(wg).alias(f"tot_{s}") for s in sums])
    same = d[PART] == F.col("_gp")
    for b in by:
        same = same & d[b].eqNullSafe(F.col(f"_g_{b}"))
    inside = Window.partitionBy(*by, PART).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = d.join(tot, same, "inner")
    return out.select(*df.columns,
                      *[(F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"run_{s}") for s in sums],
                      *[F.col(f"tot_{s}") for s in sums])


def preceding_rows(df: DataFrame, order: str, lookback: int, columns: dict, block: int = 4096,
                   tiebreak: Sequence[str] = ()) -> DataFrame:
    """Adds ``columns`` (name -> function of a window) over the ``lookback`` rows before each row.

    Rows get their position by running counts and are windowed in blocks of positions; each block also
    sees the last ``lookback`` rows of the one before it, so no task holds the whole table.
    """
    if lookback > block:
        raise ValueError("a block must cover the look-back")
    r = running_sums(df.withColumn("_one", F.lit(1)), [], order, ["_one"], tiebreak=tiebreak)
    at = F.col("run__one") - 1
    own = F.floor(at / block)
    r = r.withColumn("_own", own).withColumn("_blk", F.explode(F.array_distinct(F.array(own, F.floor((at + lookback) / block)))))
    w = Window.partitionBy("_blk").orderBy("run__one").rowsBetween(-lookback, -1)
    r = r.withColumns({k: f(w) for k, f in columns.items()}).where("_blk = _own")
    return r.select(*df.columns, *columns)


def frame_sums(df: DataFrame, key: str, time: str, frames: dict, sums: Sequence[str]) -> DataFrame:
    """Adds ``<frame>_<s>``: the sum of ``s`` over the key's rows with time in the frame, without a window per key.

    ``frames``: name -> (from, upto), offsets to the row's time: rows with time > t + from and <= t + upto count. A frame's
    sum is the difference of the running totals at its two ends: every end becomes a query row of value zero that sorts
    after the rows of its time, so one running sum over (key, time) answers all frames, however many rows a key has.
    Sums are exact for whole numbers and decimals. ``time`` is a non-null long.
    """
    d = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    zero = [F.lit(0).cast(d.schema[s].dataType).alias(s) for s in sums]
    data = d.select(key, F.col(time).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_q"),
                    F.lit(None).cast("string").alias("_end"), *sums)
    ends = F.array(*[F.struct(F.lit(f"{name}/{i}").alias("end"), (F.col(time) + off).alias("at"))
                     for name, offs in frames.items() for i, off in enumerate(offs)])
    ask = d.select(key, F.col("_row").alias("_q"), F.explode(ends).alias("e")).select(
        key, F.col("e.at").alias("_at"), F.lit(1).alias("_side"), "_q", F.col("e.end").alias("_end"), *zero)
    r = running_sums(data.unionByName(ask), [key], "_at", list(sums), tiebreak=["_side"]).where("_side = 1")
    end = lambda name, i, s: F.max(F.when(F.col("_end") == f"{name}/{i}", F.col(f"run_{s}")))
    got = r.groupBy(F.col("_q").alias("_row")).agg(*[(end(n, 1, s) - end(n, 0, s)).alias(f"{n}_{s}") for n in frames for s in sums])
    return d.join(got, "_row").drop("_row")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float],
                    prefix: str = "q") -> DataFrame:
    """Exact linear-interpolation quantiles per group without a single-task merge.

    ``percentile``/``median`` aggregates merge every distinct value of a group in
    one task. Here values become a (group, value, count) histogram (partial
    aggregation, spread by value), running counts give each value's rank
    range, and the two order statistics around h = (n - 1) q are picked by a
    conditional min. One output row per group with columns ``{prefix}{i}``.
    """
    by = list(by)
    base = df.where(F.col(value).isNotNull())
    hist = base.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    return quantiles_of(running_sums(hist, by, "_v", ["_c"]), by, qs, prefix)


def quantiles_of(r: DataFrame, by: Sequence[str], qs: Sequence[float], prefix: str = "q") -> DataFrame:
    """The quantiles from a (by, _v, _c) histogram with its running counts."""
    # rows with 0-based ranks [run - c, run - 1] hold value _v
    lo_rank = F.col("run__c") - F.col("_c")
    aggs = [F.first("tot__c").alias("_n")]
    for i, q in enumerate(qs):
        h = (F.col("tot__c") - 1) * F.lit(float(q))
        for side, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            aggs.append(F.min(F.when((lo_rank <= k) & (F.col("run__c") - 1 >= k), F.col("_v"))).alias(f"_{side}{i}"))
        aggs.append(F.first((h - F.floor(h)).alias("_f")).alias(f"_f{i}"))
    g = r.groupBy(*by).agg(*aggs)
    return g.select(*by, "_n", *[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
                                 .alias(f"{prefix}{i}") for i in range(len(qs))])
