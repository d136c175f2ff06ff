"""Typed result projection shared by a registered query and its oracle SQL.

Every registered query ends with ``project(df, kinds)`` and its SQL with
``sql_select(kinds)``: the same names, the same types (BIGINT, DOUBLE rounded
to 6 places, VARCHAR, timestamps as epoch microseconds), so results compare
value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscope.functions.columns import round_to

PLACES = 6


def typed(name: str, kind: str, c=None):
    """The typed output column of ``project`` (usable inside another projection)."""
    c = F.col(name) if c is None else c
    if kind == "l":
        return c.cast("bigint")
    if kind == "d":
        return round_to(c, PLACES)
    if kind == "s":
        return c.cast("string")
    if kind == "t":
        return F.unix_micros(c.cast("timestamp"))
    raise ValueError(kind)


def project(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*[typed(name, kind).alias(name) for name, kind in kinds.items()])


def sql_select(kinds: dict[str, str], src: str | None = None) -> str:
    out = []
    for name, kind in kinds.items():
        ref = f'{src}."{name}"' if src else f'"{name}"'
        if kind == "l":
            e = f"CAST({ref} AS BIGINT)"
        elif kind == "d":
            e = f"round(CAST({ref} AS DOUBLE), {PLACES})"
        elif kind == "s":
            e = f"CAST({ref} AS VARCHAR)"
        elif kind == "t":
            e = f"epoch_us({ref})"
        else:
            raise ValueError(kind)
        out.append(f'{e} AS "{name}"')
    return ",\n       ".join(out)


@dataclass
class Query:
    """A registered query: the Spark plan and (when SQL can express it) the DuckDB oracle."""
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


def registry(*queries: Query) -> dict[str, Query]:
    out = {}
    for q in queries:
        if q.name in out:
            raise ValueError(f"duplicate query {q.name}")
        out[q.name] = q
    return out
