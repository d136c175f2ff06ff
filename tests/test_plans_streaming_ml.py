"""Plan shape, streaming restart, ML persistence."""
import os
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veloscope.operators.features import feature_matrix
from veloscope.sources.transactions import txn_events, txn_orders


def test_feature_matrix_uses_one_exchange(spark):
    plan = feature_matrix(txn_events(spark, SF_SMALL), hot_threshold=None)._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_filter_and_columns_reach_the_scan(spark):
    df = txn_events(spark, SF_SMALL).where(F.col("amount") > 100).select("transaction_id", "amount")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,100.0)]" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_stream_restart_gives_no_duplicates(spark):
    from veloscope.plans.stream_queries import _events_feed, _parsed, stage_events
    from veloscope.streaming import jobs as J
    root = stage_events(spark, _events_feed(spark, SF_SMALL), "restart-test")
    out, ck = os.path.join(root, "out"), os.path.join(root, "ck")
    for _ in range(2):  # second run resumes from the checkpoint: nothing new to process
        q = (J.velocity_counter_stream(_parsed(spark, root)).writeStream.format("parquet")
             .option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == txn_events(spark, SF_SMALL).count()
    assert got.select("transaction_id").distinct().count() == got.count()


def test_feature_pipeline_fit_save_load(spark):
    from pyspark.ml import PipelineModel
    from veloscope.operators import learn as L
    t = txn_orders(spark, SF_SMALL)
    model = L.feature_pipeline().fit(t)
    path = os.path.join(tempfile.mkdtemp(prefix="veloscope-model-"), "pipe")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = model.transform(t).select("transaction_id", "features")
    b = again.transform(t).select("transaction_id", "features")
    assert a.exceptAll(b).count() == 0
    assert len(a.first()["features"]) == 48


def test_gbt_learns_separable_data(spark):
    from veloscope.operators import evaluation as EV
    from veloscope.operators import learn as L
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(400).select(F.col("id").alias("transaction_id"), (F.col("id") % 5 == 0).cast("int")
                                 .alias("is_fraud"), F.lit(1.0).alias("weight"))
    df = df.withColumn("x", F.col("is_fraud") * 2.0 + F.rand(7))
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    pred = L.gbt(max_iter=5, max_depth=2).fit(df).transform(df).withColumn("score", L.p1())
    assert EV.evaluate(pred).first()["auc_roc"] > 0.9


def _toy_features(spark, n=300):
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(n).select(
        F.col("id").alias("transaction_id"), (F.col("id") % 4 == 0).cast("int").alias("is_fraud"),
        F.lit(1.0).alias("weight"), (F.col("id") % 3).cast("double").alias("cat_idx"),
        (F.col("id") % 3).cast("int").alias("fold"))
    df = df.withColumn("x", F.col("is_fraud") * 1.5 + F.rand(3))
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(df)


def test_random_search_and_mlp(spark):
    from veloscope.operators import learn as L
    df = _toy_features(spark)
    cv = L.random_search(df, n_trials=2, k=3, parallelism=2, space=L.SEARCH_SPACE | {"maxIter": (5, 8)})
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > 0.5
    mlp = L.mlp_on_categories(df, ["cat_idx"], ["x"], hidden=4, max_iter=20)
    out = mlp.transform(df).withColumn("score", L.p1())
    assert out.count() == df.count()


def test_stacking_and_calibration(spark):
    from veloscope.operators import evaluation as EV
    from veloscope.operators import learn as L
    df = _toy_features(spark)
    bases, meta, oof = L.stacking(df, L.base_learners(max_iter=5), k=3)
    assert oof.count() == df.count()
    pred = L.ensemble_predict(df, bases, meta).withColumn("p_raw", F.col("fraud_probability"))
    iso = L.calibrate(pred)
    assert iso.transform(pred.select("p_raw", "is_fraud")).count() == df.count()
    assert EV.evaluate(pred.withColumn("score", F.col("fraud_probability"))).first()["auc_roc"] > 0.8
