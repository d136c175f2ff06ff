"""Registered queries for the remaining operators: A1/A4 round trip, D7b/E4b, E14, K5, K10, M8, M10."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators import evaluation as EV
from veloscope.operators import monitoring as MO
from veloscope.operators import transaction as X
from veloscope.plans.common import Query, project, registry, sql_select
from veloscope.plans.model_queries import HASH_SQL
from veloscope.session import scratch_path
from veloscope.sources import files as FI
from veloscope.sources.transactions import SOURCES

RT = {"transaction_id": "l", "user_id": "l", "amount": "d", "merchant_id": "s", "merchant_category": "s",
      "timestamp": "t", "is_fraud": "l", "score": "d"}


def _roundtrip(fmt):
    def run(spark, sf_dir):
        txn = SOURCES["events"][0](spark, sf_dir).select(*[f.name for f in FI.TRANSACTION_SCHEMA.fields])
        path = scratch_path(spark, f"roundtrip-{uuid.uuid4().hex[:8]}.{fmt}")
        FI.write_table(txn, path)
        return project(FI.ingest(spark, path), RT)
    return Query(f"roundtrip_{fmt}_events", run, f"WITH {SOURCES['events'][1]}\nSELECT {sql_select(RT)} FROM txn",
                 f"A1/A3/A4 write as {fmt} and read back with the explicit schema")


PIT = {"transaction_id": "l", "is_first_category_pit": "l", "is_first_merchant_pit": "l"}
PIT_SQL = f"""WITH {SOURCES['orders'][1]},
q AS (SELECT transaction_id,
        CASE WHEN user_id IS NOT NULL AND merchant_category IS NOT NULL THEN CAST(row_number() OVER
          (PARTITION BY user_id, merchant_category ORDER BY epoch_us("timestamp"), transaction_id) = 1 AS INTEGER)
          ELSE 0 END AS is_first_category_pit,
        CASE WHEN user_id IS NOT NULL AND merchant_id IS NOT NULL THEN CAST(row_number() OVER
          (PARTITION BY user_id, merchant_id ORDER BY epoch_us("timestamp"), transaction_id) = 1 AS INTEGER)
          ELSE 0 END AS is_first_merchant_pit FROM txn)
SELECT {sql_select(PIT)} FROM q"""

FORCE_TARGET = 1500
FORCE = {"transaction_id": "l", "is_fraud": "l"}
FORCE_SQL = f"""WITH {SOURCES['events'][1]},
h AS (SELECT *, {HASH_SQL.format(seed=K.SPLIT_SEED)} AS hk FROM txn),
r AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY hk, transaction_id) AS pos,
             sum(is_fraud) OVER () - {FORCE_TARGET} AS surplus FROM h),
q AS (SELECT transaction_id, CASE WHEN (is_fraud = 1 AND surplus > 0 AND pos <= surplus)
                                    OR (is_fraud = 0 AND surplus < 0 AND pos <= -surplus)
                                  THEN 1 - is_fraud ELSE is_fraud END AS is_fraud FROM r)
SELECT {sql_select(FORCE)} FROM q"""

OVER_RATIO = 0.5
OVS = {"is_fraud": "l", "copy": "l", "n": "l"}
OVS_SQL = f"""WITH {SOURCES['events'][1]},
c AS (SELECT count(*) FILTER (WHERE is_fraud = 1) AS p, count(*) FILTER (WHERE is_fraud = 0) AS q FROM txn),
k AS (SELECT CASE WHEN p > 0 THEN greatest(1, CAST(ceil({OVER_RATIO} * q / ((1 - {OVER_RATIO}) * p)) AS BIGINT))
                  ELSE 1 END AS k FROM c),
e AS (SELECT txn.is_fraud, unnest(CASE WHEN txn.is_fraud = 1 THEN range(0, k.k) ELSE [CAST(0 AS BIGINT)] END) AS copy
      FROM txn, k),
q AS (SELECT is_fraud, copy, count(*) AS n FROM e GROUP BY ALL)
SELECT {sql_select(OVS)} FROM q"""

PII = {"transaction_id": "l", "user_id": "s"}
PII_SQL = f"""WITH {SOURCES['events'][1]}
SELECT transaction_id, sha256('pii-salt' || CAST(user_id AS VARCHAR)) AS user_id FROM txn"""

GAUGE = {"metric": "s", "value": "d", "ts": "t"}
PERF = {"day": "t", "alert_type": "s", "title": "s", "message": "s", "severity": "s", "source": "s", "details": "s"}


def _daily_metrics(spark, sf_dir):
    txn = SOURCES["events"][0](spark, sf_dir).withColumn("day", F.date_trunc("day", "timestamp"))
    return EV.curve_metrics(EV.score_curve(txn, by=["day"]), by=["day"])


def _gauge_run(spark, sf_dir):
    m = _daily_metrics(spark, sf_dir)
    log = m.select("day", F.explode(F.create_map(F.lit("auc_pr"), F.col("auc_pr"), F.lit("auc_roc"),
                                                 F.col("auc_roc"))).alias("metric", "value")) \
           .select("metric", "value", F.col("day").alias("ts"))
    return project(MO.latest_gauges(log), GAUGE)


DAILY_CTE = f"""{SOURCES['events'][1]},
d AS (SELECT date_trunc('day', "timestamp") AS day, score AS p, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg
      FROM txn GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY day ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (PARTITION BY day ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER (PARTITION BY day) AS tpos, sum(neg) OVER (PARTITION BY day) AS tneg FROM d),
m AS (SELECT day, sum(pos * tp / (tp + fp)) / any_value(tpos) AS auc_pr,
             sum(neg * (tp - pos / 2)) / (any_value(tpos) * any_value(tneg)) AS auc_roc FROM c GROUP BY day)"""

GAUGE_SQL = f"""WITH {DAILY_CTE},
lg AS (SELECT 'auc_pr' AS metric, auc_pr AS value, day AS ts FROM m UNION ALL
       SELECT 'auc_roc', auc_roc, day FROM m),
q AS (SELECT metric, arg_max(value, (ts, value)) AS value, max(ts) AS ts FROM lg GROUP BY metric)
SELECT {sql_select(GAUGE)} FROM q"""


def _perf_run(spark, sf_dir):
    return project(MO.performance_alerts(_daily_metrics(spark, sf_dir), "auc_pr", order_col="day",
                                         min_drop_pct=1.0), PERF)


PERF_SQL = f"""WITH {DAILY_CTE},
l AS (SELECT day, auc_pr AS current, lag(auc_pr) OVER (ORDER BY day) AS baseline FROM m),
dd AS (SELECT *, CASE WHEN baseline > 0 THEN (baseline - current) / baseline * 100 END AS drop_pct FROM l),
q AS (SELECT day, 'performance' AS alert_type, 'Metric fell since the last period' AS title,
             printf('auc_pr: %.1f%% lower, %.4f to %.4f', drop_pct, baseline, current) AS message,
             CASE WHEN drop_pct > {K.PERF_DROP_CRITICAL_PCT} THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
             'evaluator' AS source,
             '{{"metric":"auc_pr","current":' || round(current, 4) || ',"baseline":' || round(baseline, 4)
               || ',"drop_pct":' || round(drop_pct, 2) || '}}' AS details
      FROM dd WHERE drop_pct > 1.0)
SELECT {sql_select(PERF)} FROM q"""


def build():
    return registry(
        _roundtrip("csv"), _roundtrip("tsv"), _roundtrip("parquet"),
        Query("first_use_pit_orders", lambda s, d: project(X.first_use_flags(SOURCES["orders"][0](s, d)), PIT),
              PIT_SQL, "D7b/E4b point-in-time first category / merchant"),
        Query("force_positive_count_events",
              lambda s, d: project(X.force_positive_count(SOURCES["events"][0](s, d), FORCE_TARGET), FORCE),
              FORCE_SQL, "E14 exactly 1500 positives by seeded hash"),
        Query("oversample_events",
              lambda s, d: project(X.oversample_minority(SOURCES["events"][0](s, d), OVER_RATIO)
                                   .groupBy("is_fraud", "copy").agg(F.count(F.lit(1)).alias("n")), OVS),
              OVS_SQL, "M10 minority replication to a 50 % share (counts per copy)"),
        Query("pii_mask_events",
              lambda s, d: project(X.mask_pii(SOURCES["events"][0](s, d), salt="pii-salt"), PII), PII_SQL,
              "M8 salted SHA-256 of user_id"),
        Query("latest_gauges_daily", _gauge_run, GAUGE_SQL, "K5 latest AUC-PR / AUC-ROC gauges from a daily log"),
        Query("performance_alerts_daily", _perf_run, PERF_SQL, "K10 day-over-day AUC-PR drop alerts"),
    )
