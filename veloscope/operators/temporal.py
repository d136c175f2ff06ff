"""Temporal features: calendar parts, sliding-window velocity, recency.

Velocity of a row = aggregates over the rows of the same user whose time lies
in (t - w, t]: equal timestamps are included, the row itself too, and the
lower bound is open. Spark's RANGE frame is closed on both ends, so the frame
is ``rangeBetween(-w_us + 1, 0)`` on epoch microseconds.

Two physical shapes compute the same values:

* ``plain``: one hash exchange on user_id; every user-level window shares it. Work per user is up to quadratic in
  its rows, so ``plain_velocity`` sends users above ``skew.DEFAULT_HOT_ROWS`` rows to the other shape.
* ``bucketed`` (for hot users): counts, sums and maxima from blocks of positions,
  distinct values from united intervals (``operators/sliding.py``): no task
  holds a user or a frame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.functions import columns as C
from veloscope.operators.skew import DEFAULT_HOT_ROWS, NULL_SALT, dealt, null_salt, split_hot

HOUR_US = 3600 * 1_000_000
DAY_US = 24 * HOUR_US
US = "_us"


def calendar_columns(ts: str = "timestamp") -> dict[str, Column]:
    return {
        "hour_of_day": F.coalesce(C.hour_of_day(ts), F.lit(0)),
        "day_of_week": F.coalesce(C.day_of_week(ts), F.lit(0)),
        "is_night": F.coalesce(C.is_night(ts), F.lit(0)),
        "is_weekend": F.coalesce(C.is_weekend(ts), F.lit(0)),
        "day_of_month": F.coalesce(C.day_of_month(ts), F.lit(0)),
    }


def with_micros(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df if US in df.columns else df.withColumn(US, C.micros(ts))


def _valid(user: str) -> Column:
    return F.col(user).isNotNull() & F.col(US).isNotNull()


def velocity_columns(frame: Callable[[int], Window], windows: Sequence[int], user: str,
                     extra_distinct: Sequence[tuple[str, str]] = (("unique_merchants", "merchant_id"),)
                     ) -> dict[str, Column]:
    """C6-C9 (and M1 through ``extra_distinct``) for each window, given a frame factory."""
    out: dict[str, Column] = {}
    ok = _valid(user)
    for h in windows:
        w = frame(h)
        out[f"txn_count_{h}h"] = F.when(ok, F.count(F.lit(1)).over(w)).otherwise(0)
        out[f"amount_sum_{h}h"] = F.when(ok, F.coalesce(F.sum("amount").over(w), F.lit(0.0))).otherwise(0.0)
        out[f"amount_max_{h}h"] = F.when(ok, F.coalesce(F.max("amount").over(w), F.lit(0.0))).otherwise(0.0)
        for prefix, col in extra_distinct:
            # count(distinct) is not allowed over a window; the set size is
            out[f"{prefix}_{h}h"] = F.when(ok, F.size(F.collect_set(col).over(w))).otherwise(0)
    return out


def salted(df: DataFrame, key: str) -> DataFrame:
    """Adds ``NULL_SALT``: the windows below spread the rows of a null key, whose values are constants."""
    if NULL_SALT in df.columns:
        return df
    return df.withColumn(NULL_SALT, null_salt(key, US, *[c for c in ("transaction_id", "amount") if c in df.columns]))


def _range_frame(partition: list[str]) -> Callable[[int], Window]:
    def frame(h: int):
        return (Window.partitionBy(*partition).orderBy(F.col(US).asc_nulls_last())
                .rangeBetween(-h * HOUR_US + 1, 0))
    return frame


def plain_velocity(df: DataFrame, windows: Sequence[int] = K.VELOCITY_WINDOWS_HOURS,
                   user: str = "user_id", extra_distinct=(("unique_merchants", "merchant_id"),),
                   hot_threshold: int | None = DEFAULT_HOT_ROWS) -> DataFrame:
    """C6-C9 by a window per user; users above ``hot_threshold`` rows take the bucketed shape (``None``: no user does)."""
    split = split_hot(with_micros(df), [user], hot_threshold)
    out = dealt(salted(split.normal, user), split.n_rows, user, NULL_SALT)
    out = out.withColumns(velocity_columns(_range_frame([user, NULL_SALT]), windows, user, extra_distinct)).drop(NULL_SALT)
    if split.hot is None:
        return out
    return out.unionByName(bucketed_velocity_recency(split.hot, windows, user, extra_distinct=extra_distinct).select(*out.columns))


def recency_columns(user: str = "user_id", id_col: str = "transaction_id") -> dict[str, Column]:
    wu = Window.partitionBy(user, NULL_SALT)
    wt = wu.orderBy(F.col(US).asc_nulls_last(), F.col(id_col))
    ok = _valid(user)
    return {
        "days_since_first_txn": F.when(ok, (F.col(US) - F.min(US).over(wu)) / float(DAY_US)).otherwise(0.0),
        "seconds_since_last_txn": F.when(
            ok, F.coalesce((F.col(US) - F.lag(US).over(wt)) / 1e6, F.lit(-1.0))).otherwise(-1.0),
    }


# ---------------------------------------------------------------------------
# bucketed (hot-user) shape, any number of rows per user
# ---------------------------------------------------------------------------

BK = "_bk"


def _user_times(df: DataFrame, windows: Sequence[int], user: str, distinct: Sequence[tuple[str, str]], amounts: bool = True) -> DataFrame:
    """Every frame value of each (user, time), by the block and interval operators; non-null users and times."""
    from veloscope.operators.sliding import sliding
    return sliding(df, user, US, {f"{h}h": h * HOUR_US for h in windows}, "amount" if amounts else None, distinct)


def _named(windows: Sequence[int], distinct: Sequence[tuple[str, str]], amounts: bool = True) -> dict[str, Column]:
    out = {}
    for h in windows:
        if amounts:
            out |= {f"txn_count_{h}h": F.col(f"n_{h}h").cast("long"), f"amount_sum_{h}h": F.col(f"s_{h}h").cast("double"),
                    f"amount_max_{h}h": F.coalesce(F.col(f"m_{h}h"), F.lit(0.0))}
        out |= {f"{p}_{h}h": F.col(f"{p}_{h}h").cast("int") for p, _ in distinct}
    return out


def _joined(df: DataFrame, times: DataFrame, user: str) -> DataFrame:
    t = times.withColumnsRenamed({user: "_tu", US: "_tt"})
    return df.join(t, (F.col(user) == F.col("_tu")) & (F.col(US) == F.col("_tt")), "left").drop("_tu", "_tt")


def distinct_velocity(df: DataFrame, windows: Sequence[int], distinct: Sequence[tuple[str, str]], user: str = "user_id") -> DataFrame:
    """C9 / M1 for every user: ``<prefix>_<h>h`` of each (prefix, column) in ``distinct``; 0 without a user or a time."""
    df = with_micros(df)
    times = _user_times(df.where(_valid(user)), windows, user, distinct, amounts=False)
    new = {k: F.coalesce(c, F.lit(0)) for k, c in _named(windows, distinct, amounts=False).items()}
    return _joined(df, times, user).select(*df.columns, *[c.alias(k) for k, c in new.items()])


def bucketed_velocity_recency(df: DataFrame, windows: Sequence[int] = K.VELOCITY_WINDOWS_HOURS, user: str = "user_id",
                              id_col: str = "transaction_id", extra_distinct=(("unique_merchants", "merchant_id"),)) -> DataFrame:
    """Velocity + recency for users of any size: blocks of positions and united intervals instead of a window per user.

    Rows without a user or a time get the null-row values (0 / -1).
    """
    from veloscope.session import cut_lineage
    d = cut_lineage(with_micros(df).withColumn("_vrow", F.monotonically_increasing_id()))
    known = d.where(_valid(user))
    times = _user_times(known, windows, user, extra_distinct)
    # of the rows at one time only the first in id order looks back to another time
    lead = known.groupBy(user, US).agg(F.min(F.struct(F.col(id_col), F.col("_vrow"))).alias("_lead"))
    times = times.join(lead, [user, US])
    ok = F.col("first").isNotNull()
    cols = {k: F.coalesce(c, F.lit(0.0) if k.startswith("amount") else F.lit(0)) for k, c in _named(windows, extra_distinct).items()}
    cols["days_since_first_txn"] = F.when(ok, (F.col(US) - F.col("first")) / float(DAY_US)).otherwise(0.0)
    gap = F.when(F.col("_vrow") == F.col("_lead._vrow"), (F.col(US) - F.col("prev")) / 1e6).otherwise(0.0)
    cols["seconds_since_last_txn"] = F.when(ok, F.coalesce(gap, F.lit(-1.0))).otherwise(-1.0)
    return _joined(d, times, user).select(*[c for c in d.columns if c != "_vrow"], *[c.alias(k) for k, c in cols.items()])


# ---------------------------------------------------------------------------
# skew-safe "previous row" (lag / last non-null) for hot keys
# ---------------------------------------------------------------------------

def previous_values(df: DataFrame, cols, keys=("user_id",), id_col: str = "transaction_id",
                    bucket_us: int = 24 * HOUR_US, prefix: str = "prev_") -> DataFrame:
    """Last non-null value of each column over the earlier rows of the key, in (time, id) order.

    Rows are windowed per (key, time bucket); the value carried in from earlier
    buckets comes from a per-(key, bucket) aggregate (partial aggregation) and a
    window over that small table, so a hot key never sits in one task.
    """
    keys = list(keys)
    # rows without a time come last: a bucket after all others
    d = with_micros(df).withColumn(BK, F.coalesce(F.floor(F.col(US) / F.lit(bucket_us)), F.lit(2**62)))
    order = [F.col(US).asc_nulls_last(), F.col(id_col)]
    w_in = Window.partitionBy(*keys, BK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_in_{c}": F.last(c, ignorenulls=True).over(w_in) for c in cols})
    per = d.groupBy(*keys, BK).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.coalesce(F.col(US), F.lit(2**62)), F.col(id_col)))).alias(f"_b_{c}")
        for c in cols])
    wb = Window.partitionBy(*keys).orderBy(BK).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, BK, *[F.last(f"_b_{c}", ignorenulls=True).over(wb).alias(f"_c_{c}") for c in cols])
    out = d.join(per, [*keys, BK], "left")
    return out.withColumns({f"{prefix}{c}": F.coalesce(F.col(f"_in_{c}"), F.col(f"_c_{c}")) for c in cols}) \
              .drop(BK, *[f"_in_{c}" for c in cols], *[f"_c_{c}" for c in cols])
