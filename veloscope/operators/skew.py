"""Hot-key detection and routing.

Per-key window operators put every row of one key into one task. A key that
holds a large share of the rows (one user with a third of all transactions)
would make that task the whole job. ``hot_keys`` finds such keys with a
partially aggregated count (map-side combine, so the count itself is skew-safe)
and ``split_hot`` routes their rows to a separate, bucketed plan. Both plans give the same values.

The hot-key table has at most ``rows / threshold`` entries; if there are any it is written once, and how it is
joined is left to the optimizer. Null keys are never hot; the windows spread them with
``null_salt``, as no feature is computed over the rows of a null key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloscope.session import written_once

# Per-user work on the plain shape is up to quadratic in the user's rows (the
# expanding spend percentile, sliding frames that recompute over the frame), so
# users above 20 000 rows take the bucketed shapes.
DEFAULT_HOT_ROWS = 20_000
#: rows that one task of a chain of windows sorts; every window of the chain holds its rows again
TASK_ROWS = 200_000
NULL_SALT = "_nsalt"


@dataclass
class HotSplit:
    normal: DataFrame
    hot: DataFrame | None
    n_hot_keys: int
    n_rows: int


def null_salt(key: str, *spread: str) -> Column:
    """A window partition column that spreads the rows of a null key and is null elsewhere."""
    return F.when(F.col(key).isNull(), F.xxhash64(*spread))


def hot_keys(df: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Keys with more than ``threshold`` rows (null keys are never hot)."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return (df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > threshold).select(*keys))


def split_hot(df: DataFrame, keys: list[str], threshold: int | None = DEFAULT_HOT_ROWS, counted: DataFrame | None = None) -> HotSplit:
    """Split ``df`` into rows of normal keys and rows of hot keys.

    ``threshold=None`` disables detection (everything is normal); ``0`` routes
    every key to the hot shape. When no key is hot the input is returned
    unchanged, so the common case costs one small aggregate job and adds no
    join to the plan. ``counted``: a plainer table with the same rows, to count keys in.
    """
    rows = df if counted is None else counted
    if threshold is None:
        return HotSplit(df, None, 0, rows.count())
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(known & (F.col("_n") > threshold)).alias("hot")).first()
    if total["hot"] == 0:
        return HotSplit(df, None, 0, total["rows"])
    hk = written_once(hot_keys(rows, keys, threshold), "hot-keys")
    return HotSplit(df.join(hk, keys, "left_anti"), df.join(hk, keys, "left_semi"), total["hot"], total["rows"])


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """``df`` (of at most ``n_rows`` rows) dealt by the keys of its windows to tasks of about ``TASK_ROWS`` rows.

    The partitions of a shuffle are a number fixed in advance, and adaptive execution merges them by their bytes, which are few for narrow
    rows, so the rows of a task, and the memory of every sort, would grow with the input. A number named here is kept as it is.
    """
    n = -(-n_rows // TASK_ROWS)
    return df if n <= 1 else df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)
