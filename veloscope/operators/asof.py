"""As-of join of two tables (G8): each row gets what a stored history held for its key at its time.

Both tables become one, range-partitioned by (key, time, side): a history row of the same time counts. Inside a partition
the last known value of each field is carried forward by a window over (key, partition); what came before the
partition is carried from a small table of (key, partition) ends. No task holds a key, and nothing is broadcast.

Every field is looked up by itself: a null in the history does not hide the older value, and a value older than
``tolerance`` before the row is null. Rows without a key or a time get nulls and are not shuffled; history rows without either are never
found. Of history rows at one time the one that sorts last by ``tiebreak`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veloscope.functions.columns import micros
from veloscope.operators.prefix import PART, range_parts

KEY, AT, SIDE, TIE, ROW = "_ak", "_at", "_side", "_tie", "_row"


def asof_join(left: DataFrame, history: DataFrame, key: str, left_time: str, history_time: str, fields: Sequence[str],
              tolerance_seconds: float | None = None, tiebreak: Sequence[str] = (), prefix: str = "last_") -> DataFrame:
    """``left`` (all its rows) with ``<prefix><field>`` and ``<prefix><field>_at`` (the time of the value) for each field of ``history``."""
    kind = history.schema[key].dataType
    rows = left.select(F.struct(*left.columns).alias(ROW), F.col(key).cast(kind).alias(KEY), micros(left_time).alias(AT))
    found = F.col(KEY).isNotNull() & F.col(AT).isNotNull()
    values = {f: F.struct(F.col(f).alias("v"), micros(history_time).alias("t")) for f in fields}
    past = history.select(F.col(key).alias(KEY), micros(history_time).alias(AT), F.struct(F.lit(0), *tiebreak).alias(TIE),
                          *[F.when(F.col(f).isNotNull(), v).alias(f"_{f}") for f, v in values.items()]).where(found)
    both = past.withColumn(SIDE, F.lit(0)).unionByName(rows.where(found).withColumn(SIDE, F.lit(1)), allowMissingColumns=True)
    order = [F.col(c).asc_nulls_last() for c in (AT, SIDE, TIE)]
    d = range_parts(both, [KEY], order)
    inside = Window.partitionBy(KEY, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the last value of each (key, partition), then of all partitions before
    ends = d.where(F.col(SIDE) == 0).groupBy(KEY, PART).agg(
        *[F.max_by(f"_{f}", F.when(F.col(f"_{f}").isNotNull(), F.struct(AT, TIE))).alias(f"_{f}") for f in fields])
    parts = d.select(KEY, PART).distinct().join(ends, [KEY, PART], "left")
    before = Window.partitionBy(KEY).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(KEY).alias("_pk"), F.col(PART).alias("_pp"),
                         *[F.last(f"_{f}", ignorenulls=True).over(before).alias(f"_c_{f}") for f in fields])
    d = d.withColumns({f"_i_{f}": F.last(f"_{f}", ignorenulls=True).over(inside) for f in fields}).where(F.col(SIDE) == 1) \
        .join(parts, (F.col(KEY) == F.col("_pk")) & (F.col(PART) == F.col("_pp")), "left")
    d = d.withColumns({f"_f_{f}": F.coalesce(f"_i_{f}", f"_c_{f}") for f in fields})
    out = d.select(ROW, AT, *[f"_f_{f}" for f in fields]).unionByName(
        rows.where(~found).select(ROW, AT), allowMissingColumns=True)
    new = []
    for f in fields:
        x = F.col(f"_f_{f}")
        if tolerance_seconds is not None:
            x = F.when(F.col(AT) - x["t"] <= int(tolerance_seconds * 1_000_000), x)
        new += [x["v"].alias(f"{prefix}{f}"), F.timestamp_micros(x["t"]).alias(f"{prefix}{f}_at")]
    return out.select(f"{ROW}.*", *new)
