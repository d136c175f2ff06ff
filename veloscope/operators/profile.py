"""Per-key aggregates attached to every row: the two physical shapes.

A feature such as "mean amount of this user" is an aggregate over a key. It
reaches the rows either

* ``OVER``: as ``agg.over(partitionBy(keys))`` -- no extra exchange when the
  rows are already hash-partitioned on user_id (a partitioning on user_id
  satisfies any clustering on (user_id, x)), or
* ``JOIN``: as ``groupBy(keys).agg(...)`` joined back -- partial aggregation
  runs map-side, so a hot key never sits whole in one task.

Rows with a null key get null (the key is not a group), like a left join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVER = "over"
JOIN = "join"


@dataclass(frozen=True)
class Distinct:
    """The number of distinct values of a column, in the form each shape can compute."""
    column: Column

    def over(self, w) -> Column:
        return F.size(F.collect_set(self.column).over(w))       # count(distinct) is not allowed over a window

    def grouped(self) -> Column:
        return F.count_distinct(self.column)                    # two-level aggregation: no set in one buffer


def distinct(c: Column) -> Distinct:
    return Distinct(c)


def grouped(aggs: dict) -> list[Column]:
    """The aggregates for ``groupBy(...).agg``, named."""
    return [(e.grouped() if isinstance(e, Distinct) else e).alias(n) for n, e in aggs.items()]


def _keys_ok(keys: list[str]) -> Column:
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return ok


def over_columns(keys: list[str], aggs: dict, spread: list[str] = ()) -> dict[str, Column]:
    """The ``OVER`` shape as a column dict (so many windows go into one projection).

    ``spread``: columns that are constant for a key and cut the rows without a key into small groups.
    """
    ok = _keys_ok(keys)
    w = Window.partitionBy(*keys, *spread)
    return {n: F.when(ok, e.over(w)) for n, e in aggs.items()}


def attach(df: DataFrame, keys: list[str], aggs: dict, how: str = OVER,
           source: DataFrame | None = None) -> DataFrame:
    """``aggs``: name → aggregate Column, or ``distinct(column)``.

    ``source`` (JOIN shape): aggregate this table instead of ``df`` -- pass the
    narrow base rows so a long chain of feature steps does not re-plan itself.
    """
    ok = _keys_ok(keys)
    if how == OVER:
        return df.withColumns(over_columns(keys, aggs))
    src = df if source is None else source
    prof = src.where(ok).groupBy(*keys).agg(*grouped(aggs))
    return df.join(prof, keys, "left")


def is_first(count: str, mode: str = "full") -> Column:
    """New to the user: the only row of the whole table, or, point in time, no earlier row."""
    return F.coalesce((F.col(count) == (1 if mode == "full" else 0)).cast("int"), F.lit(0))
