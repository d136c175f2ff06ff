"""Feature store as tables.

The online key-value store of the reference becomes a keyed table
(user_id → fields + updated_at); reads are left joins, writes are upserts
(one row per key survives, newest fields win), TTL is a filter on
``updated_at``. The velocity counter with a refreshing TTL is a session count:
it restarts after an idle gap of at least the window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators.prefix import running_sums
from veloscope.operators.skew import DEFAULT_HOT_ROWS, split_hot
from veloscope.operators.temporal import US, previous_values, with_micros

USER = "user_id"
FIELDS = ("last_txn_amount", "last_txn_timestamp", "last_txn_country")


def user_updates(txn: DataFrame) -> DataFrame:
    """The store write of each transaction: (user_id, fields, updated_at)."""
    ctry = F.col("country") if "country" in txn.columns else F.lit(K.HOME_COUNTRY)
    return txn.where(F.col(USER).isNotNull()).select(
        USER, F.col("amount").alias("last_txn_amount"), F.col("timestamp").alias("last_txn_timestamp"),
        ctry.alias("last_txn_country"), F.col("timestamp").alias("updated_at"),
        F.col("transaction_id").alias("_seq"))


def latest_per_key(updates: DataFrame, key: str = USER, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Newest write per key (ties: larger sequence id) -- partial aggregation, no per-key task."""
    order = F.struct(F.col("updated_at"), F.col("_seq"))
    # a null in a write leaves the field as it was, inside a batch as well as across batches
    return updates.groupBy(key).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields], F.max("updated_at").alias("updated_at"))


def upsert(store: DataFrame, updates: DataFrame, key: str = USER, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Merge a batch of writes into the store; the newer write wins field by field
    (a null in the newer write keeps the older value, like a JSON merge)."""
    new = latest_per_key(updates, key, fields)
    o, n = store.alias("o"), new.alias("n")
    j = o.join(n, key, "full_outer")
    newer = F.col("n.updated_at").isNotNull() & (
        F.col("o.updated_at").isNull() | (F.col("n.updated_at") >= F.col("o.updated_at")))
    cols = [F.when(newer, F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}"))).otherwise(
        F.coalesce(F.col(f"o.{f}"), F.col(f"n.{f}"))).alias(f) for f in fields]
    upd = F.when(newer, F.col("n.updated_at")).otherwise(F.col("o.updated_at")).alias("updated_at")
    return j.select(key, *cols, upd)


def live(store: DataFrame, asof, ttl_seconds: int = K.STORE_TTL_SECONDS) -> DataFrame:
    """Entries not yet expired at ``asof``."""
    a = asof if isinstance(asof, Column) else F.lit(asof).cast("timestamp")
    return store.where(F.col("updated_at") > a - F.make_interval(secs=F.lit(ttl_seconds)))


def get_features(df: DataFrame, store: DataFrame, key: str = USER) -> DataFrame:
    """Left join of the store on the key (missing → nulls)."""
    return df.join(store, key, "left")


def merchant_features(txn: DataFrame) -> DataFrame:
    """G2 writer: per merchant count, mean amount, fraud rate."""
    return (txn.where(F.col("merchant_id").isNotNull()).groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("merchant_txn_count"), F.avg("amount").alias("merchant_avg_amount"),
        F.avg("is_fraud").alias("merchant_fraud_rate")))


def session_counter(df: DataFrame, window_minutes: int, user: str = USER, id_col: str = "transaction_id",
                    name: str | None = None) -> DataFrame:
    """Counter value after each event (INCR with a TTL refreshed to the window).

    A gap of at least the window since the user's previous event expires the
    key, so the count restarts: sessions split at gap >= window, counter =
    position inside the session.
    """
    name = name or f"counter_{window_minutes}m"
    gap = window_minutes * 60 * 1_000_000
    df = with_micros(df)
    wt = Window.partitionBy(user).orderBy(F.col(US).asc_nulls_last(), F.col(id_col))
    prev = F.lag(US).over(wt)
    # an undated event comes last and starts no session, unless it is the user's first
    d = df.withColumn("_new", F.when((F.row_number().over(wt) == 1) | (F.col(US) - prev >= gap), 1).otherwise(0))
    run = wt.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_sess", F.sum("_new").over(run))
    ws = Window.partitionBy(user, "_sess").orderBy(F.col(US).asc_nulls_last(), F.col(id_col))
    return d.withColumn(name, F.row_number().over(ws)).drop("_new", "_sess")


def session_counters_distributed(df: DataFrame, windows: Sequence[int], user: str = USER,
                                 id_col: str = "transaction_id") -> DataFrame:
    """G6 for hot users, same values as ``session_counter`` without a per-user task.

    previous timestamp → new-session flags → (running sums) position and
    session number → session start position (groupBy + join) → counter.
    """
    d = previous_values(with_micros(df).withColumn("_seen", F.lit(1)), [US, "_seen"], [user], id_col, prefix="_p")
    flags = {f"_new{m}": F.when(F.col("_p_seen").isNull() | (F.col(US) - F.col(f"_p{US}") >= m * 60_000_000), 1)
             .otherwise(0) for m in windows}
    d = d.withColumns({"_one": F.lit(1), **flags})
    r = running_sums(d, [user], US, ["_one", *flags], tiebreak=[id_col])
    for m in windows:
        starts = r.groupBy(user, f"run__new{m}").agg(F.min("run__one").alias(f"_start{m}"))
        r = r.join(starts, [user, f"run__new{m}"], "left").withColumn(
            f"counter_{m}m", (F.col("run__one") - F.col(f"_start{m}") + 1).cast("int"))
    drop = [c for c in r.columns if c.startswith(("run__", "tot__", "_start", "_new", "_one", f"_p{US}", "_p_seen", "_seen"))]
    return r.drop(*drop)


def _with_nobody(out: DataFrame, df: DataFrame, user: str, constants: dict) -> DataFrame:
    """``out`` (rows with a user) and the rows without one: nobody has no history, so they need no shuffle."""
    return out.unionByName(with_micros(df).where(F.col(user).isNull()).withColumns(constants))


def session_counters(df: DataFrame, windows: Sequence[int] = K.VELOCITY_COUNTER_MINUTES, user: str = USER,
                     id_col: str = "transaction_id", hot_threshold: int | None = DEFAULT_HOT_ROWS) -> DataFrame:
    """G6 for all windows; hot users take the distributed shape. An event without a user is counted by itself (1)."""
    split = split_hot(with_micros(df).where(F.col(user).isNotNull()), [user], hot_threshold)
    plain = split.normal
    for m in windows:
        plain = session_counter(plain, m, user, id_col)
    if split.hot is not None:
        plain = plain.unionByName(session_counters_distributed(split.hot, windows, user, id_col))
    return _with_nobody(plain, df, user, {f"counter_{m}m": F.lit(1) for m in windows})


def velocity_lookup(df: DataFrame, windows: Sequence[int] = K.VELOCITY_COUNTER_MINUTES, user: str = USER,
                    id_col: str = "transaction_id", hot_threshold: int | None = DEFAULT_HOT_ROWS) -> DataFrame:
    """Counter read *before* each event's own increment: events since the last idle
    gap >= window, 0.0 when the key has expired; columns velocity_{m}m (double)."""
    out = session_counters(df, windows, user, id_col, hot_threshold)
    return out.withColumns({f"velocity_{m}m": (F.col(f"counter_{m}m") - 1).cast("double") for m in windows}) \
              .drop(*[f"counter_{m}m" for m in windows])


def asof_profile(df: DataFrame, cols: Sequence[str] = ("amount", "timestamp"), user: str = USER,
                 id_col: str = "transaction_id", hot_threshold: int | None = DEFAULT_HOT_ROWS) -> DataFrame:
    """What the store held for the user just before this event: the previous
    event's fields (last non-null; null for the first event, or without a user)."""
    split = split_hot(with_micros(df).where(F.col(user).isNotNull()), [user], hot_threshold)
    w = (Window.partitionBy(user).orderBy(F.col(US).asc_nulls_last(), F.col(id_col))
         .rowsBetween(Window.unboundedPreceding, -1))
    plain = split.normal.withColumns({f"prev_{c}": F.last(c, ignorenulls=True).over(w) for c in cols})
    if split.hot is not None:
        plain = plain.unionByName(previous_values(split.hot, list(cols), [user], id_col))
    return _with_nobody(plain, df, user, {f"prev_{c}": F.lit(None).cast(df.schema[c].dataType) for c in cols})
