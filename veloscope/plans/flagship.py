"""Flagship: which users show abnormal velocity?

events → valid rows (B5/B4) → 24 h velocity + user profile + z-score (one
exchange on user_id) → per-user report with the peak 24 h count/spend, the
number of amount outliers and the risk tier of the user's highest score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.functions import columns as C
from veloscope.operators.features import compute_features
from veloscope.plans.common import project, sql_select
from veloscope.sources.transactions import TXN_EVENTS_CTE, txn_events

KINDS = {"user_id": "l", "n_txn": "l", "peak_txn_24h": "l", "peak_spend_24h": "d",
         "max_amount_zscore": "d", "n_amount_outliers": "l", "max_score": "d", "risk_tier": "s"}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    txn = txn_events(spark, sf_dir)
    valid = txn.where(F.col("transaction_id").isNotNull() & F.col("user_id").isNotNull()
                      & F.col("amount").between(K.MIN_AMOUNT, K.MAX_AMOUNT))
    feat = compute_features(valid, groups=("velocity", "transaction"), windows=(24,), keep=("score",))
    rep = feat.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_txn"),
        F.max("txn_count_24h").alias("peak_txn_24h"),
        F.max("amount_sum_24h").alias("peak_spend_24h"),
        F.max("amount_zscore").alias("max_amount_zscore"),
        F.count_if(F.col("amount_zscore") > 3).alias("n_amount_outliers"),
        F.max("score").alias("max_score"),
    ).withColumn("risk_tier", C.risk_tier("max_score"))
    return project(rep, KINDS)


FLAGSHIP_SQL = f"""WITH {TXN_EVENTS_CTE},
v AS (SELECT * FROM txn WHERE transaction_id IS NOT NULL AND user_id IS NOT NULL
                         AND amount BETWEEN {K.MIN_AMOUNT} AND {K.MAX_AMOUNT}),
f AS (SELECT *, count(*) OVER w AS c24, coalesce(sum(amount) OVER w, 0) AS s24,
             coalesce((amount - avg(amount) OVER (PARTITION BY user_id))
                      / (coalesce(stddev_samp(amount) OVER (PARTITION BY user_id), 1) + 1e-8), 0) AS z
      FROM v WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us("timestamp")
                          RANGE BETWEEN {24 * 3600 * 1_000_000 - 1} PRECEDING AND CURRENT ROW)),
r AS (SELECT user_id, count(*) AS n_txn, max(c24) AS peak_txn_24h, max(s24) AS peak_spend_24h,
             max(z) AS max_amount_zscore, count(*) FILTER (WHERE z > 3) AS n_amount_outliers,
             max(score) AS max_score
      FROM f GROUP BY user_id),
t AS (SELECT *, CASE WHEN max_score >= {K.TIER_CRITICAL} THEN 'CRITICAL' WHEN max_score >= {K.TIER_HIGH}
                     THEN 'HIGH' WHEN max_score >= {K.TIER_MEDIUM} THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier
      FROM r)
SELECT {sql_select(KINDS)} FROM t"""
