"""Registered feature-store queries (G1-G8) on transactions derived from events/orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators import store as ST
from veloscope.operators.asof import asof_join
from veloscope.operators.drift import split_by_time
from veloscope.plans.common import Query, project, registry, sql_select
from veloscope.session import written_once
from veloscope.sources.transactions import SOURCES

STORE = {"user_id": "l", "last_txn_amount": "d", "last_txn_timestamp": "t", "last_txn_country": "s",
         "updated_at": "t"}


def _store(spark, sf_dir, source="orders"):
    """Store after two write batches: the first half of the period, then the second half."""
    txn = SOURCES[source][0](spark, sf_dir)
    first, second = split_by_time(txn)
    empty = spark.createDataFrame([], "user_id long, last_txn_amount double, last_txn_timestamp timestamp, "
                                      "last_txn_country string, updated_at timestamp")
    s1 = ST.upsert(empty, ST.user_updates(first))
    return ST.upsert(s1, ST.user_updates(second))


STORE_SQL_CTE = f"""{SOURCES['orders'][1]},
s AS (SELECT user_id, arg_max(amount, ("timestamp", transaction_id)) AS last_txn_amount,
             max("timestamp") AS last_txn_timestamp,
             arg_max(country, ("timestamp", transaction_id)) AS last_txn_country, max("timestamp") AS updated_at
      FROM txn WHERE user_id IS NOT NULL GROUP BY user_id)"""

GET = {"transaction_id": "l", "user_id": "l", "last_txn_amount": "d", "last_txn_country": "s",
       "merchant_txn_count": "l", "merchant_avg_amount": "d", "merchant_fraud_rate": "d"}


def _get_run(spark, sf_dir):
    txn = SOURCES["orders"][0](spark, sf_dir)
    store = _store(spark, sf_dir)
    out = ST.get_features(txn.select("transaction_id", "user_id", "merchant_id"), store)
    out = ST.get_features(out, ST.merchant_features(txn), key="merchant_id")
    return project(out, GET)


GET_SQL = f"""WITH {STORE_SQL_CTE},
m AS (SELECT merchant_id, count(*) AS merchant_txn_count, avg(amount) AS merchant_avg_amount,
             avg(is_fraud) AS merchant_fraud_rate FROM txn WHERE merchant_id IS NOT NULL GROUP BY 1),
q AS (SELECT t.transaction_id, t.user_id, s.last_txn_amount, s.last_txn_country, m.merchant_txn_count,
             m.merchant_avg_amount, m.merchant_fraud_rate
      FROM txn t LEFT JOIN s ON t.user_id = s.user_id LEFT JOIN m ON t.merchant_id = m.merchant_id)
SELECT {sql_select(GET)} FROM q"""

LIVE = {"user_id": "l", "updated_at": "t"}


def _live_run(spark, sf_dir):
    store = _store(spark, sf_dir, "events")
    asof = store.agg(F.max("updated_at").alias("a"))
    return project(ST.live(store.crossJoin(F.broadcast(asof)), F.col("a"), K.STORE_TTL_LONG_SECONDS), LIVE)


LIVE_SQL = f"""WITH {SOURCES['events'][1]},
s AS (SELECT user_id, max("timestamp") AS updated_at FROM txn WHERE user_id IS NOT NULL GROUP BY user_id),
q AS (SELECT * FROM s WHERE updated_at > (SELECT max(updated_at) FROM s) - INTERVAL {K.STORE_TTL_LONG_SECONDS} SECONDS)
SELECT {sql_select(LIVE)} FROM q"""

VEL = {"transaction_id": "l", "user_id": "l", "counter_60m": "l",
       **{f"velocity_{m}m": "d" for m in K.VELOCITY_COUNTER_MINUTES}}


def _vel_run(spark, sf_dir, hot_threshold=None):
    txn = SOURCES["events"][0](spark, sf_dir)
    kw = {} if hot_threshold is None else {"hot_threshold": hot_threshold}
    out = ST.session_counters(txn, K.VELOCITY_COUNTER_MINUTES, **kw)
    out = out.withColumns({f"velocity_{m}m": (F.col(f"counter_{m}m") - 1).cast("double")
                           for m in K.VELOCITY_COUNTER_MINUTES})
    return project(out, VEL)


def _vel_sql():
    parts = []
    for m in K.VELOCITY_COUNTER_MINUTES:
        gap = m * 60 * 1_000_000
        parts.append(f"""s{m} AS (SELECT transaction_id, sum(CASE WHEN prev IS NULL OR us - prev >= {gap} THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING) AS sess, user_id, us FROM b),
c{m} AS (SELECT transaction_id, row_number() OVER (PARTITION BY user_id, sess ORDER BY us, transaction_id) AS c FROM s{m})""")
    joins = " ".join(f"JOIN c{m} USING (transaction_id)" for m in K.VELOCITY_COUNTER_MINUTES)
    cols = ", ".join(f"CAST(c{m}.c - 1 AS DOUBLE) AS velocity_{m}m" for m in K.VELOCITY_COUNTER_MINUTES)
    return f"""WITH {SOURCES['events'][1]},
b AS (SELECT *, epoch_us("timestamp") AS us,
             lag(epoch_us("timestamp")) OVER (PARTITION BY user_id ORDER BY epoch_us("timestamp"), transaction_id) AS prev
      FROM txn),
{','.join(parts)},
q AS (SELECT b.transaction_id, b.user_id, c60.c AS counter_60m, {cols} FROM b {joins})
SELECT {sql_select(VEL)} FROM q"""


ASOF = {"transaction_id": "l", "user_id": "l", "prev_amount": "d", "prev_timestamp": "t"}
ASOF_SQL = f"""WITH {SOURCES['orders'][1]},
q AS (SELECT *, lag(amount) OVER w AS prev_amount, lag("timestamp") OVER w AS prev_timestamp FROM txn
      WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us("timestamp"), transaction_id))
SELECT {sql_select(ASOF)} FROM q"""


JOIN = {"transaction_id": "l", "user_id": "l", "last_amount": "d", "last_amount_at": "t", "last_country": "s"}
JOIN_DAYS = 90


def _join_run(spark, sf_dir):
    """Half of the orders as a stored history with null fields, the other half looked up in it; 30 % of the rows have no user,
    one user has a third of the rest."""
    i = F.col("transaction_id")
    txn = SOURCES["orders"][0](spark, sf_dir).withColumn(
        "user_id", F.when(i % 10 < 3, None).when(i % 3 == 0, 1).otherwise(F.col("user_id")))
    past = txn.where(i % 4 < 2).select("user_id", "timestamp", "transaction_id", F.when(i % 17 != 4, F.col("amount")).alias("amount"),
                                       F.when(i % 5 != 1, F.col("country")).alias("country"))
    history = written_once(past, "history")
    out = asof_join(txn.where(i % 4 >= 2).select("transaction_id", "user_id", "timestamp"), history, "user_id", "timestamp", "timestamp",
                    ["amount", "country"], tolerance_seconds=JOIN_DAYS * 86_400, tiebreak=["transaction_id"])
    return project(out, JOIN)


JOIN_SQL = f"""WITH {SOURCES['orders'][1]},
d AS (SELECT transaction_id, "timestamp" AS ts, CASE WHEN transaction_id % 10 < 3 THEN NULL WHEN transaction_id % 3 = 0 THEN 1 ELSE user_id END AS user_id,
             CASE WHEN transaction_id % 17 <> 4 THEN amount END AS amount, CASE WHEN transaction_id % 5 <> 1 THEN country END AS country FROM txn),
q AS (SELECT l.transaction_id, l.user_id, arg_max(h.amount, (h.ts, h.transaction_id)) FILTER (WHERE h.amount IS NOT NULL) AS last_amount,
             max(h.ts) FILTER (WHERE h.amount IS NOT NULL) AS last_amount_at,
             arg_max(h.country, (h.ts, h.transaction_id)) FILTER (WHERE h.country IS NOT NULL) AS last_country
      FROM d l LEFT JOIN d h ON h.transaction_id % 4 < 2 AND h.user_id = l.user_id AND h.ts <= l.ts AND h.ts >= l.ts - INTERVAL {JOIN_DAYS} DAY
      WHERE l.transaction_id % 4 >= 2 GROUP BY 1, 2)
SELECT {sql_select(JOIN)} FROM q"""


def build():
    return registry(
        Query("store_upsert_orders", lambda s, d: project(_store(s, d), STORE),
              f"WITH {STORE_SQL_CTE}\nSELECT {sql_select(STORE)} FROM s", "G4 two-batch upsert of user features"),
        Query("store_get_features_orders", _get_run, GET_SQL, "G1-G3 user and merchant feature lookups"),
        Query("store_live_ttl_events", _live_run, LIVE_SQL, "G5 entries alive under the 24 h TTL"),
        Query("velocity_counters_events", _vel_run, _vel_sql(),
              "G6 session counter (TTL refreshed per event) and G7 lookups for 60/360/1440/10080 min"),
        Query("velocity_counters_hot_path_events", lambda s, d: _vel_run(s, d, hot_threshold=0), _vel_sql(),
              "G6/G7 with every user on the distributed (hot-user) shape"),
        Query("asof_profile_orders",
              lambda s, d: project(ST.asof_profile(SOURCES["orders"][0](s, d)), ASOF), ASOF_SQL,
              "G8 profile as of each transaction (previous event's fields)"),
        Query("asof_profile_hot_path_orders",
              lambda s, d: project(ST.asof_profile(SOURCES["orders"][0](s, d), hot_threshold=0), ASOF), ASOF_SQL,
              "G8 with every user on the distributed (hot-user) shape"),
        Query("asof_join_orders_history", _join_run, JOIN_SQL,
              "G8 as a join of two tables: null users kept, null fields, one user with a third of the rows, 90 days of tolerance"),
    )
