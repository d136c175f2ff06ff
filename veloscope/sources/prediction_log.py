"""Prediction log derived from ``events``: one scored request per event.

Columns: transaction_id, timestamp, user_id, amount, is_fraud,
fraud_probability (the stand-in score), risk_tier, environment, latency_ms,
store_status (hit/miss/error), store_latency_ms, error_type. All derived
deterministically from event columns, so the monitoring queries grow with
the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscope.functions.columns import round_to

from veloscope.functions import columns as C
from veloscope.sources.transactions import read_table


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    p = round_to(F.col("value") / 500.0, 2)
    return ev.select(
        F.col("event_id").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id"),
        F.col("value").alias("amount"),
        (F.col("event_type") == "error").cast("int").alias("is_fraud"),
        p.alias("fraud_probability"),
        C.risk_tier(p).alias("risk_tier"),
        F.when(F.col("user_id") % 4 == 0, "staging").otherwise("production").alias("environment"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "miss")
         .otherwise("hit").alias("store_status"),
        (F.col("value") / 10.0).alias("store_latency_ms"),
        F.when(F.col("event_type") == "error",
               F.when(F.col("value") >= 100, "timeout").otherwise("validation")).alias("error_type"),
    )


PREDICTION_LOG_CTE = """log AS (
  SELECT event_id AS transaction_id, CAST(ts AS TIMESTAMP) AS "timestamp", user_id, value AS amount,
         CAST(event_type = 'error' AS INTEGER) AS is_fraud,
         round(value / 500.0, 2) AS fraud_probability,
         CASE WHEN round(value / 500.0, 2) >= 0.85 THEN 'CRITICAL' WHEN round(value / 500.0, 2) >= 0.6 THEN 'HIGH'
              WHEN round(value / 500.0, 2) >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
         CASE WHEN user_id % 4 = 0 THEN 'staging' ELSE 'production' END AS environment,
         value AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'miss' ELSE 'hit' END
           AS store_status,
         value / 10.0 AS store_latency_ms,
         CASE WHEN event_type = 'error' THEN CASE WHEN value >= 100 THEN 'timeout' ELSE 'validation' END END
           AS error_type
  FROM events)"""
