"""Registered queries that fit, save, load and score (F7, H1, H7, H10, A14), batch and stream.

The model is a pipeline with fixed coefficients over fitted features, so that SQL can state every score: the
features are fitted on the first half of the period, saved together with the pipeline, loaded again and
applied to the second half.
"""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloscope.operators import scoring as S
from veloscope.operators.drift import split_by_time
from veloscope.operators.fitted import FittedFeatures, fit_features
from veloscope.plans.common import Query, project, registry, sql_select
from veloscope.plans.stream_queries import _events_feed, as_messages, run_slices
from veloscope.session import scratch_path
from veloscope.sources.transactions import SOURCES
from veloscope.streaming import jobs as J

#: log-odds of the fixed model, as an expression over feature names (valid in both engines)
LOGIT = ("-2.0 + 0.8 * least(amount_vs_user_avg, 5.0) + 0.1 * txn_count_24h + 0.002 * amount_sum_6h "
         "+ 0.7 * is_new_merchant + 0.4 * is_night - 0.5 * category_frequency_ratio")
VERSION = "fixed-1"
SCORED = {"transaction_id": "l", "fraud_probability": "d", "fraud_label": "l", "risk_tier": "s", "model_version": "s"}


def fixed_model(spark) -> PipelineModel:
    stage = SQLTransformer(statement=f"SELECT *, 1.0 / (1.0 + exp(-({LOGIT}))) AS fraud_probability FROM __THIS__")
    return Pipeline(stages=[stage]).fit(spark.createDataFrame([], "x int"))


def saved(spark, train: DataFrame) -> str:
    """Fit and save features and model; returns the folder."""
    path = scratch_path(spark, f"model-{uuid.uuid4().hex[:8]}")
    fit_features(train).save(f"{path}/features")
    fixed_model(spark).write().save(f"{path}/model")
    return path


def score_saved(events: DataFrame, path: str, before: int | None = None) -> DataFrame:
    """Score events with the features and the model saved in ``path``."""
    features = FittedFeatures.load(events.sparkSession, f"{path}/features", before)
    return PipelineModel.load(f"{path}/model").transform(features.transform(events))


def _batch_run(spark, sf_dir):
    first, second = split_by_time(SOURCES["events"][0](spark, sf_dir))
    out = score_saved(second, saved(spark, first))
    return project(S.score_batch(out, model_version=VERSION), SCORED)


def _stream_run(spark, sf_dir):
    """The same feed as messages, a slice at a time; scored events join the stored rows before the next slice."""
    first, second = split_by_time(_events_feed(spark, sf_dir))
    path = saved(spark, first.withColumns({"transaction_id": F.col("transaction_id").cast("string"),
                                           "user_id": F.col("user_id").cast("string")}))

    def score(events, epoch):
        FittedFeatures.load(spark, f"{path}/features", epoch).observe(events, f"{path}/features", epoch)
        return score_saved(events, path, epoch)

    root = scratch_path(spark, f"stream-model-{uuid.uuid4().hex[:8]}")
    run_slices(spark, as_messages(second), root, lambda raw: J.scoring_stream(raw, f"{root}/sink", f"{root}/ck", score, VERSION))
    return project(spark.read.parquet(f"{root}/sink/predictions"), SCORED)


def score_sql(where: str = "true", tier: str = "") -> str:
    from veloscope.plans.scoring_queries import TIER_SQL
    return f"""WITH {SOURCES['events'][1]},
mid AS (SELECT make_timestamp((epoch_us(min("timestamp")) + epoch_us(max("timestamp"))) // 2) AS m FROM txn),
a AS (SELECT txn.* FROM txn, mid WHERE "timestamp" < m), b AS (SELECT txn.* FROM txn, mid WHERE "timestamp" >= m),
seen AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE {where}),
u AS (SELECT user_id, avg(amount) AS mean, count(*) AS n FROM a GROUP BY 1),
c AS (SELECT user_id, merchant_category, count(*) AS nc FROM a GROUP BY 1, 2),
m AS (SELECT DISTINCT user_id, merchant_id, 1 AS known FROM a),
v AS (SELECT b.transaction_id, count(*) FILTER (WHERE s."timestamp" > b."timestamp" - INTERVAL 24 HOUR) AS txn_count_24h,
             coalesce(sum(s.amount) FILTER (WHERE s."timestamp" > b."timestamp" - INTERVAL 6 HOUR), 0) AS amount_sum_6h
      FROM b JOIN seen s ON s.user_id = b.user_id AND s."timestamp" <= b."timestamp" AND s."timestamp" > b."timestamp" - INTERVAL 24 HOUR
      GROUP BY 1),
f AS (SELECT b.transaction_id, coalesce(b.amount / (u.mean + 1e-8), 0) AS amount_vs_user_avg, v.txn_count_24h, v.amount_sum_6h,
             CASE WHEN m.known IS NULL THEN 1 ELSE 0 END AS is_new_merchant,
             CASE WHEN hour(b."timestamp") >= 23 OR hour(b."timestamp") < 5 THEN 1 ELSE 0 END AS is_night,
             coalesce(c.nc / (u.n + 1e-8), 0) AS category_frequency_ratio
      FROM b LEFT JOIN u USING (user_id) LEFT JOIN c USING (user_id, merchant_category) LEFT JOIN m USING (user_id, merchant_id)
      JOIN v USING (transaction_id) WHERE {where}),
s AS (SELECT transaction_id, 1.0 / (1.0 + exp(-({LOGIT}))) AS p FROM f),
q AS (SELECT transaction_id, p AS fraud_probability, CAST(p >= 0.5 AS INTEGER) AS fraud_label, {TIER_SQL.format(p='p')} AS risk_tier,
             '{VERSION}' AS model_version FROM s)
SELECT {sql_select(SCORED)} FROM q"""


def build():
    return registry(
        Query("score_saved_model_events", _batch_run, score_sql(),
              "F7, H1, A14: features and model fitted, saved, loaded and applied to later events"),
        Query("stream_saved_model_events", _stream_run, score_sql("b.merchant_category <> 'error' AND b.amount > 0".replace("b.", "")),
              "H10: the saved model on the stream, each micro-batch seeing the events before it"),
    )
