"""Registered streaming queries: each stages a driver table as JSON event files
(a time slice at a time, one file per partition), runs the stream to completion on each with
``availableNow`` and returns what the sinks received, so the result can be
checked against the batch SQL of the same operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.functions import columns as C
from veloscope.plans.common import Query, project, registry, sql_select
from veloscope.plans.scoring_queries import TIER_SQL
from veloscope.plans.store_queries import _vel_sql
from veloscope.session import scratch_path
from veloscope.sources.transactions import SOURCES
from veloscope.streaming import jobs as J
from veloscope.streaming import sources as SS
from veloscope.streaming import ttl_store as TS

SLICES = 4


def sliced(txn: DataFrame, slices: int = SLICES) -> DataFrame:
    """Adds ``_slice`` by quarter of the period; rows without a time travel with the first."""
    mm = txn.agg(F.unix_micros(F.min("timestamp")).alias("_a"), F.unix_micros(F.max("timestamp")).alias("_b"))
    at = F.floor((F.unix_micros("timestamp") - F.col("_a")) * slices / F.greatest(F.col("_b") - F.col("_a"), F.lit(1)))
    return txn.crossJoin(F.broadcast(mm)).withColumn("_slice", F.coalesce(F.least(at, F.lit(slices - 1)), F.lit(0))).drop("_a", "_b")


def stage_messages(messages: DataFrame, root: str, i: int) -> None:
    """One time slice (``_slice``, ``value``) as message files, one per partition."""
    messages.where(F.col("_slice") == i).select("value").write.text(f"{root}/in/slice_{i:03d}")


def stage_events(spark: SparkSession, txn: DataFrame, name: str, slices: int = SLICES) -> str:
    """Write ``txn`` as event JSON into a fresh folder, one time slice per sub-folder."""
    root = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:8]}")
    messages = as_messages(txn)
    for i in range(slices):
        stage_messages(messages, root, i)
    return root


def as_messages(txn: DataFrame) -> DataFrame:
    t = sliced(txn)
    return SS.to_event_json(t, keep=("_slice",))


def run_slices(spark, messages: DataFrame, root: str, start, slices: int = SLICES) -> None:
    """Stage a slice, run the stream until it is done, and so on: each slice is a micro-batch after a restart."""
    for i in range(slices):
        stage_messages(messages, root, i)
        start(SS.text_stream(spark, f"{root}/in/slice_*")).awaitTermination()


def run_to_parquet(spark, messages: DataFrame, root: str, build, slices: int = SLICES) -> DataFrame:
    def start(raw):
        d = build(SS.good_events(SS.parse_events(raw)))
        return (d.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
                .outputMode("append").trigger(availableNow=True).start())
    run_slices(spark, messages, root, start, slices)
    return spark.read.parquet(f"{root}/out")


def _root(spark, name: str) -> str:
    return scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:8]}")


def _events_feed(spark, sf_dir):
    """events as an event feed; the event types become categories of the contract ('error' does not keep it)."""
    t = SOURCES["events"][0](spark, sf_dir)
    return t.withColumn("merchant_category", category())


#: event type -> category of the contract
CATEGORY = {"click": "electronics", "view": "groceries", "purchase": "travel", "signup": "other"}


def category():
    c = F.col("merchant_category")
    for k, v in CATEGORY.items():
        c = F.when(F.col("merchant_category") == k, v).otherwise(c)
    return c


def _parsed(spark, root):
    return SS.good_events(SS.parse_events(SS.text_stream(spark, f"{root}/in/slice_*", max_files_per_trigger=1)))


BOUND = {"transaction_id": "l", "within_bound": "l", "one_of_many": "l"}
MAX_FILES = 2


def _bounded_run(spark, sf_dir):
    """One run over everything that waits, in micro-batches of at most ``MAX_FILES`` files; a batch that is repeated overwrites itself."""
    messages, root = as_messages(_events_feed(spark, sf_dir)), _root(spark, "bounded")
    for i in range(SLICES):
        stage_messages(messages, root, i)

    def sink(batch: DataFrame, number: int) -> None:
        files = batch.agg(F.count_distinct("file").alias("files"))
        good = SS.good_events(SS.parse_events(batch)).select("transaction_id")
        good.crossJoin(F.broadcast(files)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    raw = SS.text_stream(spark, f"{root}/in/slice_*", max_files_per_trigger=MAX_FILES).withColumn("file", F.input_file_name())
    raw.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    batches = out.agg(F.count_distinct("batch").alias("batches"))
    return project(out.crossJoin(F.broadcast(batches)).select("transaction_id", (F.col("files") <= MAX_FILES).cast("int").alias("within_bound"),
                                                              (F.col("batches") > 1).cast("int").alias("one_of_many")), BOUND)


BOUND_SQL = f"""WITH {SOURCES['events'][1]}, q AS (SELECT transaction_id, 1 AS within_bound, 1 AS one_of_many FROM txn)
SELECT {sql_select(BOUND)} FROM q"""

VEL = {"transaction_id": "l", "user_id": "l", "counter_60m": "l"}


def _vel_run(spark, sf_dir):
    messages = as_messages(_events_feed(spark, sf_dir))
    return project(run_to_parquet(spark, messages, _root(spark, "velocity"), J.velocity_counter_stream), VEL)


def _vel_stream_sql():
    base, _ = _vel_sql().rsplit("SELECT", 1)
    return base + f"SELECT {sql_select(VEL)} FROM q"


SCORED = {"transaction_id": "l", "fraud_probability": "d", "fraud_label": "l", "risk_tier": "s", "decision": "s"}


def _score_sinks(spark, sf_dir) -> str:
    """Run the scoring stream over a feed of which some messages are cut short or lack a time; returns the sinks' folder."""
    t = _events_feed(spark, sf_dir)
    t = t.withColumn("timestamp", F.when(F.col("transaction_id") % 13 != 5, F.col("timestamp")))
    m = as_messages(t).withColumn("value", F.when(F.col("_id") % 11 == 3, F.expr("left(value, length(value) - 7)")).otherwise(F.col("value")))
    root = _root(spark, "scoring")
    run_slices(spark, m, root, lambda raw: J.scoring_stream(raw, f"{root}/sink", f"{root}/checkpoint"))
    return f"{root}/sink"


def _score_run(spark, sf_dir):
    return project(spark.read.parquet(f"{_score_sinks(spark, sf_dir)}/predictions"), SCORED)


def _alert_run(spark, sf_dir):
    return project(spark.read.parquet(f"{_score_sinks(spark, sf_dir)}/alerts"), SCORED)


LEFT_OUT = {"transaction_id": "l", "why": "s"}


def _left_out_run(spark, sf_dir):
    sinks = _score_sinks(spark, sf_dir)
    dead = spark.read.parquet(f"{sinks}/dead_letters").select(
        F.regexp_extract("value", '"transaction_id":"([0-9]+)"', 1).cast("long").alias("transaction_id"), F.col("reason").alias("why"))
    bad = spark.read.parquet(f"{sinks}/rejects").select("transaction_id", F.col("contract_errors").alias("why"))
    return project(dead.unionByName(bad.withColumn("transaction_id", F.col("transaction_id").cast("long"))), LEFT_OUT)


_READABLE = "transaction_id % 11 <> 3 AND transaction_id % 13 <> 5"
SCORE_CTE = f"""{SOURCES['events'][1]},
s AS (SELECT transaction_id, round(least(amount / 500.0, 1.0), 2) AS p FROM txn
      WHERE amount > 0 AND merchant_category <> 'error' AND {_READABLE}),
q AS (SELECT transaction_id, p AS fraud_probability, CAST(p >= 0.5 AS INTEGER) AS fraud_label,
             {TIER_SQL.format(p='p')} AS risk_tier,
             CASE WHEN p >= {K.DECISION_BLOCK} THEN 'block' WHEN p >= {K.DECISION_REVIEW} THEN 'review'
                  ELSE 'allow' END AS decision FROM s)"""
SCORE_SQL = f"WITH {SCORE_CTE} SELECT {sql_select(SCORED)} FROM q"
ALERT_SQL = f"WITH {SCORE_CTE} SELECT {sql_select(SCORED)} FROM q WHERE risk_tier IN ('HIGH', 'CRITICAL')"
LEFT_OUT_SQL = f"""WITH {SOURCES['events'][1]},
q AS (SELECT transaction_id, CASE WHEN transaction_id % 11 = 3 THEN 'unreadable' WHEN transaction_id % 13 = 5 THEN 'no timestamp'
             ELSE concat_ws('; ', CASE WHEN amount <= 0 THEN 'amount range' END,
                                  CASE WHEN merchant_category = 'error' THEN 'merchant_category enum' END) END AS why FROM txn)
SELECT {sql_select(LEFT_OUT)} FROM q WHERE why <> ''"""

ROLL = {"window_start": "t", "window_end": "t", "n_total": "l", "n_flagged": "l", "fraud_rate": "d"}


def _roll_run(spark, sf_dir):
    def build(ev):
        return J.rolling_fraud_rate_stream(ev.withColumn("fraud_probability", C.round_to(F.col("amount") / 500.0, 2)))
    return project(run_to_parquet(spark, as_messages(_events_feed(spark, sf_dir)), _root(spark, "rolling"), build), ROLL)


ROLL_SQL = f"""WITH {SOURCES['events'][1]},
lg AS (SELECT *, round(amount / 500.0, 2) AS fraud_probability FROM txn),
w AS (SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, count(*) AS n_total,
             count(*) FILTER (WHERE fraud_probability >= 0.5) AS n_flagged,
             count(*) FILTER (WHERE fraud_probability >= 0.5) / count(*) AS fraud_rate
      FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, "timestamp") - k * INTERVAL 5 MINUTE AS ws
            FROM lg, range(12) t(k)) GROUP BY ws),
q AS (SELECT * FROM w WHERE window_end <= (SELECT max("timestamp") FROM txn) - INTERVAL 10 MINUTE)
SELECT {sql_select(ROLL)} FROM q"""

STORE = {"user_id": "l", "last_txn_amount": "d", "last_txn_timestamp": "t", "updated_at": "t"}


def _store_run(spark, sf_dir):
    root = _root(spark, "store")

    def start(raw):
        parsed = SS.good_events(SS.parse_events(raw)).select(
            F.col("transaction_id").cast("long").alias("transaction_id"), F.col("user_id").cast("long").alias("user_id"),
            "amount", "timestamp")
        return (parsed.writeStream.option("checkpointLocation", f"{root}/checkpoint")
                .foreachBatch(J.store_upsert_batch(f"{root}/store")).trigger(availableNow=True).start())

    run_slices(spark, as_messages(_events_feed(spark, sf_dir)), root, start)
    return project(J.read_store(spark, f"{root}/store"), STORE)


STORE_SQL = f"""WITH {SOURCES['events'][1]},
q AS (SELECT user_id, arg_max(amount, ("timestamp", transaction_id)) AS last_txn_amount,
             max("timestamp") AS last_txn_timestamp, max("timestamp") AS updated_at FROM txn GROUP BY user_id)
SELECT {sql_select(STORE)} FROM q"""

TTL_STORE = {"user_id": "l", "state": "s", "last_txn_amount": "d", "last_category": "s", "n_writes": "l", "n_categories": "l", "updated_at": "t"}
TTL = K.STORE_TTL_LONG_SECONDS


def _ttl_store_run(spark, sf_dir):
    """Entries expire as the watermark passes their last write by a day; every fifth event carries no amount."""
    t = _events_feed(spark, sf_dir).withColumn("amount", F.when(F.col("transaction_id") % 5 != 0, F.col("amount")))
    root = _root(spark, "ttl-store")
    with TS.state_conf(spark):
        expired = run_to_parquet(spark, as_messages(t), root, lambda ev: TS.expiring_store(ev, TTL))
    rows = expired.drop("expired_ms").withColumn("state", F.lit("expired")).unionByName(
        TS.lookup(spark, f"{root}/checkpoint").withColumn("state", F.lit("live")))
    return project(rows.select("user_id", "state", F.col("amount").alias("last_txn_amount"), F.col("merchant_category").alias("last_category"),
                               "n_writes", "n_categories", F.timestamp_micros("updated_us").alias("updated_at")), TTL_STORE)


TTL_STORE_SQL = f"""WITH {SOURCES['events'][1]},
mm AS (SELECT epoch_us(min("timestamp")) AS a, epoch_us(max("timestamp")) AS b FROM txn),
e AS (SELECT t.user_id, t.transaction_id, t."timestamp", CASE WHEN t.transaction_id % 5 <> 0 THEN t.amount END AS amount,
             CASE t.merchant_category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY.items())} ELSE t.merchant_category END AS category,
             epoch_us(t."timestamp") AS us,
             least({SLICES - 1}, CAST(floor((epoch_us(t."timestamp") - a) * {SLICES} / greatest(b - a, 1)) AS BIGINT)) AS sl
      FROM txn t, mm WHERE t.user_id IS NOT NULL),
m AS (SELECT sl, max(us) AS top FROM e GROUP BY sl),
w AS (SELECT sl, max(top) OVER (ORDER BY sl ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - 600000 AS passed FROM m),
u AS (SELECT user_id, sl, max(us) AS last_us FROM e GROUP BY user_id, sl),
p AS (SELECT user_id, sl, lag(last_us) OVER (PARTITION BY user_id ORDER BY sl) // 1000 + {TTL * 1000} AS deadline FROM u),
l AS (SELECT user_id, sl, sum(CASE WHEN deadline IS NULL OR deadline <= passed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sl) AS life
      FROM p JOIN w USING (sl)),
g AS (SELECT user_id, life, arg_max(amount, ("timestamp", transaction_id)) AS last_txn_amount,
             arg_max(category, ("timestamp", transaction_id)) AS last_category, count(*) AS n_writes,
             count(DISTINCT category) AS n_categories, max("timestamp") AS updated_at, max(us) AS last_us
      FROM e JOIN l USING (user_id, sl) GROUP BY user_id, life),
q AS (SELECT *, CASE WHEN last_us // 1000 + {TTL * 1000} <= (SELECT max(us) FROM e) // 1000 - 600000 THEN 'expired' ELSE 'live' END AS state FROM g)
SELECT {sql_select(TTL_STORE)} FROM q"""

DEDUP = {"transaction_id": "l"}


def _dedupe_run(spark, sf_dir):
    """A delay longer than the whole period: one row per id."""
    txn = SOURCES["lineitem"][0](spark, sf_dir).withColumn("merchant_category", F.lit("other"))
    out = run_to_parquet(spark, as_messages(txn), _root(spark, "dedupe"), lambda ev: J.dedupe_stream(ev, delay="5000 days"))
    return project(out, DEDUP)


DEDUP_SQL = f"""WITH {SOURCES['lineitem'][1]}, q AS (SELECT DISTINCT transaction_id FROM txn)
SELECT {sql_select(DEDUP)} FROM q"""

LATE = {"transaction_id": "l", "counter_60m": "l"}


def _late_run(spark, sf_dir):
    """Every 7th event comes a micro-batch late: it belongs to the session that is open when it arrives."""
    t = _events_feed(spark, sf_dir)
    m = as_messages(t).withColumn("_slice", F.when((F.col("_id") % 7 == 0) & (F.col("_slice") < SLICES - 1), F.col("_slice") + 1)
                                  .otherwise(F.col("_slice")))
    out = run_to_parquet(spark, m, _root(spark, "late"), lambda ev: J.velocity_counter_stream(ev, watermark="5000 days"))
    return project(out, LATE)


LATE_SQL = f"""WITH {SOURCES['events'][1]},
mm AS (SELECT epoch_us(min("timestamp")) AS a, epoch_us(max("timestamp")) AS b FROM txn),
s AS (SELECT t.*, epoch_us("timestamp") AS us, least({SLICES - 1}, CAST(floor((epoch_us("timestamp") - a) * {SLICES} / greatest(b - a, 1)) AS BIGINT)) AS sl
      FROM txn t, mm),
r AS (SELECT *, CASE WHEN transaction_id % 7 = 0 AND sl < {SLICES - 1} THEN sl + 1 ELSE sl END AS batch FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch, us, CAST(transaction_id AS VARCHAR)) AS pos,
             max(us) OVER (PARTITION BY user_id ORDER BY batch, us, CAST(transaction_id AS VARCHAR)
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
n AS (SELECT *, CASE WHEN prev IS NULL OR us - prev >= 3600000000 THEN pos END AS start FROM o),
q AS (SELECT transaction_id, pos - max(start) OVER (PARTITION BY user_id ORDER BY pos) + 1 AS counter_60m FROM n)
SELECT {sql_select(LATE)} FROM q"""


def build():
    return registry(
        Query("stream_bounded_batches_events", _bounded_run, BOUND_SQL, "A7: bounded micro-batches, every message in one of them once"),
        Query("stream_velocity_counters_events", _vel_run, _vel_stream_sql(),
              "G6 on a stream: keyed state counters across 4 micro-batches equal the batch session counts"),
        Query("stream_scoring_events", _score_run, SCORE_SQL,
              "A6-A10, H10: file stream → parse → contract → score → predictions sink"),
        Query("stream_alerts_events", _alert_run, ALERT_SQL, "A10: the alert sink, read back"),
        Query("stream_left_out_events", _left_out_run, LEFT_OUT_SQL,
              "A8, B12: dead letters (unreadable, no time) and contract rejects, with their reasons"),
        Query("stream_late_counters_events", _late_run, LATE_SQL, "G6 with events that come a micro-batch late"),
        Query("stream_rolling_fraud_rate_events", _roll_run, ROLL_SQL,
              "K6 on a stream: watermark 10 min, 1 h windows sliding 5 min, closed windows only"),
        Query("stream_store_upsert_events", _store_run, STORE_SQL, "G4 on a stream: foreachBatch upserts"),
        Query("stream_ttl_store_events", _ttl_store_run, TTL_STORE_SQL,
              "G1, G4, G5 on a stream: entries as keyed state with a time to live, expired ones emitted, live ones read from the state"),
        Query("stream_dedupe_lineitem", _dedupe_run, DEDUP_SQL, "M9 dropDuplicatesWithinWatermark on repeated order ids"),
    )
