"""Point-in-time profiles (D1, D3-D7, D9, E1, E5, E11): what a user's rows looked like before each row.

The value of a row covers the user's earlier rows only, in (time, transaction_id) order (undated rows last, repeated ids in row
order), so a training row never sees the future and a later row is profiled as it would be when it arrives.

Two shapes give the same values. ``plain_profile``: windows over a user's earlier rows, which share the exchange of the other
user windows; for users of at most ``PLAIN_ROWS`` rows, as its median sorts the earlier amounts at every row. ``point_in_time_profile``:
for users of any size, no task holds a user. ``running_states`` scans mergeable states (count, mean, M2; distinct days with the first and last
day; sums) over balanced range partitions: windows run inside a (user, partition), the states of whole (user, partition)s
are merged in order over the small table of them, and the two are merged per row. States are only ever added, never
subtracted, so NaN, infinities and large amounts behave as in a window over the user. Counts per (user, category) and (user,
merchant) come from one running count, and each device counts at its first row.

``running_median`` cuts a user's amounts into blocks of positions, max(``BLOCK``, sqrt(amounts)) long. Inside a block the median moves by
at most half a block of ranks, so a block needs its own amounts and the earlier ones around the middle only: those of the value
buckets that hold the middle ranks, found from the counts per (block, bucket). With blocks and buckets of a square root's size these
counts are no more than the amounts themselves.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloscope.functions import columns as C
from veloscope.operators.prefix import PART, ordered, range_parts, running_sums
from veloscope.operators.temporal import US, with_micros
from veloscope.session import cut_lineage, written_once

RID = "_pit_row"
BLOCK = 4096
#: users of more rows take the distributed shape
PLAIN_ROWS = 1_000
USER, ID = "user_id", "transaction_id"


def merge_moments(n0: Column, mean0: Column, m20: Column, n1: Column, mean1: Column, m21: Column) -> tuple[Column, Column, Column]:
    """The (count, mean, M2) of two sets together."""
    n, d = n0 + n1, mean1 - mean0
    both, near = (n0 > 0) & (n1 > 0), F.abs(d) < float("inf")          # false too where both means are the same infinity, or NaN
    mean = F.when(both, F.when(near, mean0 + d * (n1 / n)).otherwise(mean0 + mean1)).otherwise(F.when(n1 > 0, mean1).otherwise(mean0))
    m2 = F.when(both, F.when(near, m20 + m21 + d * d * (n0 * (n1 / n))).otherwise(float("nan"))).otherwise(F.when(n1 > 0, m21).otherwise(m20))
    return n, mean, m2


def _scan_parts(parts: DataFrame, key: str, sums: Sequence[str]) -> DataFrame:
    """Exclusive merges of the partition states of each key, in partition order (a small table: partitions + keys)."""
    names = [*sums, "n", "mean", "m2", "days", "first", "last"]
    schema = parts.select(key, PART, *[F.col(c).alias(f"o_{c}") for c in sums], F.col("n").alias("o_n"), F.col("mean").alias("o_mean"),
                          F.col("m2").alias("o_m2"), F.col("days").alias("o_days"), F.lit(True).alias("o_joined")).schema

    def run(batches):
        at, state = object(), None
        for b in batches:
            keys, out = b.column(key).to_pylist(), []
            for k, *x in zip(keys, *(b.column(c).to_pylist() for c in names)):
                *add, n, mean, m2, days, first, last = x
                if k != at:
                    at, state = k, ([0] * len(add), 0, None, None, 0, None)
                total, n0, mean0, m20, days0, last0 = state
                joined = first is not None and first == last0       # the day before goes on
                out.append((*total, n0, mean0, m20, days0, joined))
                if n0 and n:
                    d = mean - mean0
                    if abs(d) < float("inf"):
                        mean, m2 = mean0 + d * (n / (n0 + n)), m20 + m2 + d * d * (n0 * (n / (n0 + n)))
                    else:
                        mean, m2 = mean0 + mean, float("nan")
                elif n0:
                    mean, m2 = mean0, m20
                state = ([s + (a or 0) for s, a in zip(total, add)], n0 + n, mean, m2, days0 + days - joined, last0 if last is None else last)
            fields = pa.schema([pa.field(f"o_{c}", pa.float64() if schema[f"o_{c}"].dataType.typeName() == "double" else pa.int64()) for c in sums])
            kinds = [f.type for f in fields] + [pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(PART), *cols], [key, PART, *[f"o_{c}" for c in (*sums, "n", "mean", "m2", "days", "joined")]])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.select(key, PART, *names).repartition(n, key).sortWithinPartitions(key, PART).mapInArrow(run, schema)


def running_states(df: DataFrame, key: str, order: Sequence[str], value: str, day: str, sums: Sequence[str]) -> DataFrame:
    """Adds, over the earlier rows of the key (non-null): ``n``, ``mean``, ``m2`` of ``value``, the distinct ``day``s, and the
    ``sums`` (``p_`` before each name)."""
    d = range_parts(df, [key], [ordered(c) for c in order])
    w = Window.partitionBy(key, PART).orderBy(*[ordered(c) for c in order])
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new_day = F.col(day).isNotNull() & ~F.col(day).eqNullSafe(F.lag(day).over(w))
    d = d.withColumn("i_new", new_day.cast("long"))
    parts = d.groupBy(key, PART).agg(
        *[F.sum(s).alias(s) for s in sums], F.count(value).alias("n"), F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"), F.sum("i_new").alias("days"), F.min(day).alias("first"), F.max(day).alias("last"))
    o = _scan_parts(parts, key, sums).withColumnsRenamed({key: "o_key", PART: "o_part"})
    d = d.join(o, (F.col(key) == F.col("o_key")) & (F.col(PART) == F.col("o_part")))
    n1, days = F.count(value).over(before), F.coalesce(F.sum("i_new").over(before), F.lit(0))
    d = d.withColumns({"i_n": n1, "i_mean": F.avg(value).over(before), "i_m2": F.var_pop(value).over(before), "i_days": days,
                       **{f"i_{s}": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums}})
    n, mean, m2 = merge_moments(F.col("o_n"), F.col("o_mean"), F.col("o_m2"), F.col("i_n"), F.col("i_mean"), F.col("i_m2") * F.col("i_n"))
    return d.select(*df.columns, n.alias("p_n"), mean.alias("p_mean"), m2.alias("p_m2"),
                    (F.col("o_days") + F.col("i_days") - (F.col("o_joined") & (F.col("i_days") > 0)).cast("long")).alias("p_days"),
                    *[(F.col(f"o_{s}") + F.col(f"i_{s}")).alias(f"p_{s}") for s in sums])


def _middles(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, block, value, below): for each block after the first the earlier values around the middle, and how many are smaller."""
    size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt("of")).cast("long"))
    long = values.where(F.col("of") >= BLOCK).select(key, "m", value, "block", size.alias("size"), "of")
    r = running_sums(long.withColumn("one", F.lit(1).cast("long")), [key], value, ["one"], tiebreak=["m"])
    r = written_once(r.withColumn("bucket", F.floor((F.col("run_one") - 1) / F.col("size"))).drop("one", "run_one", "tot_one"), "ranks")
    cells = r.groupBy(key, (F.col("block") + 1).alias("block"), "bucket").agg(F.count(F.lit(1)).alias("c"))
    grid = r.groupBy(key).agg(F.max(F.floor(F.col("of") / F.col("size"))).alias("blocks"), F.max("bucket").alias("buckets"), F.max("size").alias("size"))
    grid = grid.where("blocks > 0").select(key, "size", "buckets", F.explode(F.sequence(F.lit(1).cast("long"), "blocks")).alias("block")) \
        .select(key, "size", "block", F.explode(F.sequence(F.lit(0).cast("long"), "buckets")).alias("bucket"))
    grid = grid.join(cells, [key, "block", "bucket"], "left")
    have = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy(key, "bucket").orderBy("block"))
    grid = grid.withColumn("have", have)
    upto = F.sum("have").over(Window.partitionBy(key, "block").orderBy("bucket"))
    middle = F.floor(F.col("block") * F.col("size") / 2)
    reach = F.floor(F.col("size") / 2) + 2
    near = grid.withColumn("upto", upto).where((F.col("have") > 0) & (F.col("upto") > middle - reach) & (F.col("upto") - F.col("have") < middle + reach))
    near = near.withColumn("below", F.min(F.col("upto") - F.col("have")).over(Window.partitionBy(key, "block")))
    near = near.select(F.col(key).alias("_k"), F.col("block").alias("_b"), F.col("bucket").alias("_c"), "below")
    return r.join(near, (F.col(key) == F.col("_k")) & (F.col("bucket") == F.col("_c")) & (F.col("block") < F.col("_b"))) \
        .select(key, F.col("_b").alias("block"), value, "below")


def running_median(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, m, median): the median of the key's first m values, m = 0 .. all. ``values``: (key, m, value, of): the value
    after the first m of ``of`` (non-null key and value)."""
    size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt("of")).cast("long"))
    v = values.select(key, F.col("m").cast("long").alias("m"), F.col(value).cast("double").alias(value), F.col("of").cast("long").alias("of"))
    v = written_once(v.withColumn("block", F.floor(F.col("m") / size)), "amounts")
    last = v.where("m = of - 1").select(key, F.col("of").alias("m"), F.lit(None).cast("double").alias(value),
                                        F.floor(F.col("of") / size).alias("block"))
    none = F.lit(None).cast("long")
    rows = v.select(key, "block", F.col("m"), value, none.alias("below")).unionByName(last.select(key, "block", "m", value, none.alias("below"))) \
        .unionByName(_middles(v, key, value).select(key, "block", F.lit(-1).cast("long").alias("m"), value, "below"))

    def run(batches):
        at, held, nans, below = object(), [], 0, 0
        for b in batches:
            keys, ms, out = b.column(key).to_pylist(), b.column("m").to_pylist(), []
            for k, block, m, x, low in zip(keys, b.column("block").to_pylist(), ms, b.column(value).to_pylist(), b.column("below").to_pylist()):
                if (k, block) != at:
                    at, held, nans, below = (k, block), [], 0, 0
                if m < 0:
                    below = low
                else:
                    a, z = (m - 1) // 2 - below, m // 2 - below
                    out.append(None if not m else (held[a] + held[z]) / 2 if z < len(held) else float("nan"))
                if x is None:
                    continue
                if x != x:
                    nans += 1                   # above all other values
                else:
                    insort(held, x)
            keep = [i for i, m in enumerate(ms) if m >= 0]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(keep, pa.int64())), b.column("m").take(pa.array(keep, pa.int64())),
                                              pa.array(out, pa.float64())], [key, "m", "median"])

    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, key, "block").sortWithinPartitions(key, "block", "m", value)
    return rows.mapInArrow(run, v.select(key, "m", F.lit(None).cast("double").alias("median")).schema)


def _earlier_counts(base: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(RID, a column per key): earlier rows of the same user and key value, one running count for all keys."""
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("string").alias("value")) for name, c in keys.items()])
    d = base.select(RID, USER, US, ID, F.explode(each).alias("x")).select(RID, USER, US, ID, "x.name", "x.value", F.lit(1).cast("long").alias("one"))
    r = running_sums(d.where("value IS NOT NULL"), [USER, "name", "value"], US, ["one"], tiebreak=[ID, RID])
    return r.groupBy(RID).agg(*[F.max(F.when(F.col("name") == name, F.col("run_one") - 1)).alias(name) for name in keys])


def plain_profile(df: DataFrame, spread: Sequence[str] = ()) -> DataFrame:
    """The columns of ``point_in_time_profile`` by windows per user. ``df`` has ``US``, ``RID`` and ``is_night``; ``spread``: columns
    that are constant for a user and cut the rows without one into small groups."""
    known, amount = F.col(USER).isNotNull(), F.col("amount").cast("double")

    def window(*more):
        return Window.partitionBy(USER, *spread, *more).orderBy(*[ordered(c) for c in (US, ID, RID)])

    day, nth = F.to_date("timestamp"), F.row_number()
    df = df.withColumn("_new_day", (day.isNotNull() & ~day.eqNullSafe(F.lag(day).over(window()))).cast("long"))
    keys = {n: c for n, c in (("_uc_count", "merchant_category"), ("_um_count", "merchant_id")) if c in df.columns}
    firsts = {n: F.when(known & F.col(c).isNotNull(), (nth.over(window(c)) - 1).cast("long")) for n, c in keys.items()}
    if "device_fingerprint" in df.columns:          # a device counts at its first row
        firsts["_new_device"] = (F.col("device_fingerprint").isNotNull() & (nth.over(window("device_fingerprint")) == 1)).cast("long")
    df = df.withColumns(firsts) if firsts else df
    before = window().rowsBetween(Window.unboundedPreceding, -1)
    n, total = F.count(amount).over(before), lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    dated = F.when(F.col("timestamp").isNotNull(), F.coalesce(amount, F.lit(0.0))).otherwise(0.0)
    out = {
        "_u_mean": F.avg(amount).over(before), "_u_std": F.when(n > 1, F.stddev_samp(amount).over(before)),
        "_u_sorted": F.sort_array(F.collect_list(amount).over(before)), "_u_count": F.count(ID).over(before),
        "_u_rows": F.count(F.lit(1)).over(before), "_u_night": F.avg("is_night").over(before), "_u_spend": F.sum(amount).over(before),
        "_u_dated_spend": F.when(n > 0, F.sum(dated).over(before)), "_u_days": total("_new_day"),
    }
    if "_new_device" in firsts:
        out["_u_devices"] = total("_new_device")
    df = df.withColumns({k: F.when(known, c) for k, c in out.items()})
    m, at = F.size("_u_sorted"), lambda i: F.get("_u_sorted", F.floor(i).cast("int"))
    median = F.when(known & (m > 0), (at((m - 1) / 2) + at(m / 2)) / 2)
    return df.withColumn("_u_median", median).drop("_u_sorted", "_new_day", "_new_device", RID)


def point_in_time_profile(df: DataFrame) -> DataFrame:
    """``df`` with the profile columns of ``behavioral.user_aggs``, ``_uc_count`` and ``_um_count`` over earlier rows (null without a user)."""
    night = F.col("is_night") if "is_night" in df.columns else F.coalesce(C.is_night("timestamp"), F.lit(0))
    base = cut_lineage(with_micros(df).withColumn(RID, F.monotonically_increasing_id()))
    known = base.where(F.col(USER).isNotNull())
    amount = F.col("amount").cast("double")
    d = known.select(RID, USER, US, ID, amount.alias("amount"), F.to_date("timestamp").cast("date").alias("day"),
                     F.lit(1).cast("long").alias("rows"), F.col(ID).isNotNull().cast("long").alias("ids"), night.cast("long").alias("night"),
                     F.coalesce(amount, F.lit(0.0)).alias("spend"),
                     F.when(F.col("timestamp").isNotNull(), F.coalesce(amount, F.lit(0.0))).otherwise(0.0).alias("dated"),
                     *([F.col("device_fingerprint").alias("device")] if "device_fingerprint" in df.columns else []))
    sums = ["rows", "ids", "night", "spend", "dated"]
    if "device" in d.columns:           # a device counts at its first row
        at = F.struct(F.coalesce(US, F.lit(2**62)).alias("us"), ID, RID)
        first = d.where(F.col("device").isNotNull()).groupBy(USER, "device").agg(F.min(at).alias("f")).select(F.col(f"f.{RID}").alias(RID))
        d = d.join(first.withColumn("devices", F.lit(1).cast("long")), RID, "left").withColumn("devices", F.coalesce("devices", F.lit(0))).drop("device")
        sums.append("devices")
    s = written_once(running_states(d, USER, [US, ID, RID], "amount", "day", sums), "states")
    amounts = s.where(F.col("amount").isNotNull()).select(USER, F.col("p_n").alias("m"), "amount")
    total = amounts.groupBy(USER).agg(F.count(F.lit(1)).alias("of"))
    median = running_median(amounts.join(total, USER), USER, "amount")
    some = F.col("p_rows") > 0
    out = {
        "_u_mean": F.col("p_mean"), "_u_std": F.when(F.col("p_n") > 1, F.sqrt(F.col("p_m2") / (F.col("p_n") - 1))),
        "_u_median": F.col("median"), "_u_count": F.col("p_ids"), "_u_rows": F.col("p_rows"),
        "_u_night": F.when(some, F.col("p_night") / F.col("p_rows")), "_u_spend": F.when(F.col("p_n") > 0, F.col("p_spend")),
        "_u_dated_spend": F.when(F.col("p_n") > 0, F.col("p_dated")), "_u_days": F.col("p_days"),
    }
    if "devices" in sums:
        out["_u_devices"] = F.col("p_devices")
    s = s.join(median.select(F.col(USER).alias("_k"), F.col("m").alias("_m"), "median"), (F.col(USER) == F.col("_k")) & (F.col("p_n") == F.col("_m")), "left")
    prof = s.select(RID, *[c.alias(n) for n, c in out.items()])
    keys = {n: c for n, c in (("_uc_count", "merchant_category"), ("_um_count", "merchant_id")) if c in df.columns}
    if keys:
        prof = prof.join(_earlier_counts(known, keys), RID, "left")
    return base.join(prof, RID, "left").drop(RID, *([] if US in df.columns else [US]))
