"""Training job: gates, early stopping, calibration in use, stored scores; fitted features; scoring one event."""
import duckdb
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veloscope.operators import behavioral as B
from veloscope.operators import learn as L
from veloscope.operators import splits as SP
from veloscope.operators.drift import split_by_time
from veloscope.operators.features import feature_matrix, feature_names
from veloscope.operators.fitted import FittedFeatures, fit_features
from veloscope.plans import training_job as TJ
from veloscope.sources.transactions import txn_events


def test_requirements_stop_the_job(spark, tmp_path):
    with pytest.raises(TJ.RequirementsNotMet, match="need at least 10000 rows"):
        TJ.training_job(txn_events(spark, SF_SMALL), str(tmp_path))
    with pytest.raises(TJ.RequirementsNotMet, match="fraud rows"):
        TJ.check_requirements(txn_events(spark, SF_SMALL), min_rows=10, min_fraud=900)


def test_low_quality_stops_the_job(spark):
    ok = spark.createDataFrame([(0.72, "keep")], "test_auc_pr double, gate string")
    TJ.check_quality(ok)
    with pytest.raises(TJ.QualityTooLow):
        TJ.check_quality(spark.createDataFrame([(0.5, "fail")], "test_auc_pr double, gate string"))


def test_job_on_events(spark, tmp_path):
    """The category gives the label away, so the job must reach the register gate; its metrics are those of the stored scores."""
    out = str(tmp_path)
    row = TJ.training_job(txn_events(spark, SF_SMALL), out, k=2, max_iter=4, min_rows=500, min_fraud=50).first()
    assert row["gate"] == "register" and row["test_auc_pr"] > 0.95
    con = duckdb.connect()
    n, pos, brier = con.sql(f"SELECT count(*), sum(is_fraud), avg(power(score - is_fraud, 2)) FROM '{out}/test_scores/*.parquet'").fetchall()[0]
    assert n == row["test_n_samples"] and pos == row["test_n_fraud"] and abs(brier - row["test_brier_score"]) < 1e-9
    raw = con.sql(f"SELECT count(DISTINCT p_raw) FROM '{out}/test_scores/*.parquet' WHERE p_raw <> score").fetchall()[0][0]
    assert raw > 0                                                      # the metrics are of calibrated scores
    reg = spark.read.parquet(f"{out}/registry").collect()
    assert [(r["version"], r["stage"]) for r in reg] == [(1, "Staging")] and "mlp" in reg[0]["description"]
    # the saved artefacts, read back, score the same rows alike
    job = TJ.load_job(out)
    stored = {r["transaction_id"]: r for r in spark.read.parquet(f"{out}/test_scores").collect()}
    again = job.score(feature_matrix(txn_events(spark, SF_SMALL), mode="point_in_time"))
    again = {r["transaction_id"]: r for r in again.collect() if r["transaction_id"] in stored}
    assert len(again) == len(stored) == n
    assert all(abs(again[i]["p_raw"] - r["p_raw"]) < 1e-9 and abs(again[i]["score"] - r["score"]) < 1e-9 for i, r in stored.items())
    # The meta model's probability recomputed from the stored base scores
    lr = job.meta.stages[-1]
    w = ", ".join(f"{c!r} * p_{k}" for c, k in zip(lr.coefficients.toArray().tolist(), ("gbt", "lr", "mlp"))).replace(", ", " + ")
    worst = con.sql(f"SELECT max(abs(p_raw - 1 / (1 + exp(-({w} + {lr.intercept!r}))))) FROM '{out}/test_scores/*.parquet'").fetchall()[0][0]
    assert worst < 1e-9


def test_held_out_features_are_those_of_the_whole_table(spark):
    """Whatever part a row falls into, it has the velocity of the whole table and the profile of its user's earlier rows."""
    t = txn_events(spark, SF_SMALL)
    got = {r["transaction_id"]: r for r in TJ.prepare(t, 2).collect()}
    whole = {r["transaction_id"]: r for r in feature_matrix(t).collect()}
    rows = sorted(t.collect(), key=lambda r: (r["timestamp"], r["transaction_id"]))
    seen, held = {}, 0
    for r in rows:
        g, before = got[r["transaction_id"]], seen.setdefault(r["user_id"], [])
        held += g["split"] != "train"
        for c in ("txn_count_168h", "unique_merchants_24h", "seconds_since_last_txn", "spend_percentile"):
            assert g[c] == whole[r["transaction_id"]][c], (c, g["split"])
        mean = sum(before) / len(before) if before else None
        assert g["user_txn_count"] == len(before)
        assert abs(g["amount_vs_user_avg"] - (0 if mean is None else r["amount"] / (mean + 1e-8))) < 1e-6
        before.append(r["amount"])
    assert held > 200


def test_early_stopping_uses_the_indicator(spark):
    df = spark.range(400).select(F.col("id").alias("transaction_id"), (F.col("id") % 3 == 0).cast("int").alias("is_fraud"),
                                 F.lit(1.0).alias("weight"), (F.col("id") % 4 == 0).alias("stop_on"), F.rand(5).alias("x"))
    from pyspark.ml.feature import VectorAssembler
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    model = L.base_learners(max_iter=30, validation="stop_on", mlp=False)["gbt"].fit(df)
    assert model.getNumTrees < 30                                       # noise: it stops early


def test_fitted_features_of_later_rows(spark, tmp_path):
    t = txn_events(spark, SF_SMALL).orderBy("timestamp")
    cut = t.agg(F.expr("percentile_approx(unix_micros(timestamp), 0.7)")).first()[0]
    train, later = t.where(F.unix_micros("timestamp") <= cut), t.where(F.unix_micros("timestamp") > cut)
    fit_features(train).save(str(tmp_path / "f"))
    back = FittedFeatures.load(spark, str(tmp_path / "f"))
    got = back.transform(later)
    assert [c for c in got.columns if c in feature_names()] == [n for n in feature_names() if n in got.columns]
    assert got.count() == later.count()
    # velocity of later rows equals that of the whole table
    whole = {r["transaction_id"]: r for r in feature_matrix(t).collect()}
    rows = got.collect()
    for r in rows:
        for c in ("txn_count_1h", "txn_count_168h", "unique_merchants_24h", "hour_of_day"):
            assert r[c] == whole[r["transaction_id"]][c], c
        assert abs(r["amount_sum_24h"] - whole[r["transaction_id"]]["amount_sum_24h"]) < 1e-6
        assert abs(r["seconds_since_last_txn"] - whole[r["transaction_id"]]["seconds_since_last_txn"]) < 1e-6
    # profile statistics are the training ones
    mean = {r["user_id"]: r["m"] for r in train.groupBy("user_id").agg(F.avg("amount").alias("m")).collect()}
    for r in rows:
        if r["user_id"] in mean:
            assert abs(r["amount_vs_user_avg"] - r["amount"] / (mean[r["user_id"]] + 1e-8)) < 1e-6
    # one event alone sees its history, and only that
    one = later.orderBy("timestamp").limit(1)
    alone = back.transform(one).first()
    same = next(r for r in rows if r["transaction_id"] == alone["transaction_id"])
    assert alone["txn_count_168h"] == same["txn_count_168h"] > 1


def test_saved_model_scores_alike(spark, tmp_path):
    from veloscope.plans.model_scoring_queries import fixed_model
    t = txn_events(spark, SF_SMALL)
    x = feature_matrix(t)
    m = fixed_model(spark)
    m.write().save(str(tmp_path / "m"))
    a, b = (k.transform(x).select("transaction_id", "fraud_probability") for k in (m, PipelineModel.load(str(tmp_path / "m"))))
    assert a.exceptAll(b).count() == 0


def test_backtest_fits_each_window(spark, tmp_path):
    from veloscope.operators import splits as SP
    from veloscope.operators.backtest import backtest
    from veloscope.sources.transactions import txn_orders
    got = {r["window_id"]: r for r in backtest(txn_orders(spark, SF_SMALL), str(tmp_path / "bt"), 600, 200, 400,
                                               min_train_rows=100).collect()}
    con = duckdb.connect()
    want = con.sql(f"""WITH s AS (SELECT window_id, is_fraud, score FROM read_parquet('{tmp_path}/bt/*/*.parquet', hive_partitioning = true)),
      p AS (SELECT a.window_id, avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc
            FROM s a JOIN s b USING (window_id) WHERE a.is_fraud = 1 AND b.is_fraud = 0 GROUP BY 1)
      SELECT window_id, count(*), any_value(auc) FROM s LEFT JOIN p USING (window_id) GROUP BY 1""").fetchall()
    assert len(got) == len(want) >= 2
    plain = SP.walk_forward_windows(txn_orders(spark, SF_SMALL), "timestamp", 600, 200, 400)
    stats = SP.window_stats(SP.assign_windows(txn_orders(spark, SF_SMALL), plain, "timestamp", 600, 200, 400), plain, min_train_rows=100)
    assert set(got) == {r["window_id"] for r in stats.where("status = 'ok'").collect()}
    for w, n, auc in want:
        assert got[int(w)]["backtest_n_samples"] == n
        assert auc is None or abs(got[int(w)]["backtest_auc_roc"] - auc) < 1e-9


def test_step_state_adds_up_to_the_windows(spark):
    from veloscope.operators import backtest as BT
    from veloscope.sources.transactions import txn_orders
    t = txn_orders(spark, SF_SMALL).withColumn("is_fraud", F.when(F.col("transaction_id") % 7 > 0, F.col("is_fraud")))
    x = BT.step_features(t, 60)
    state, rows = BT.StepState(x), x.select("step", "is_fraud", "merchant_category", "country").collect()
    for a, z in ((0, 3), (2, 9), (5, 500), (700, 800)):
        mine = [r for r in rows if a <= r["step"] < z]
        assert state.counts(a, z) == (len(mine), sum(r["is_fraud"] == 1 for r in mine), sum(r["is_fraud"] == 0 for r in mine))
    enc = state.encoder(2, 4)
    labels = {c: m.labels for c, m in zip(L.CATEGORICAL, enc.stages)}
    known = [r for r in rows if 2 <= r["step"] < 4 and r["is_fraud"] is not None]
    assert labels["merchant_category"] == sorted({r["merchant_category"] for r in known})
    assert labels["country"] == sorted({r["country"] for r in known})


def test_windows_of_any_length_equal_the_range_join(spark):
    from veloscope.operators import splits as SP
    from veloscope.sources.transactions import txn_orders
    t = txn_orders(spark, SF_SMALL)
    for train, test, step in ((600, 200, 400), (180, 30, 30), (100, 170, 45)):
        w = SP.walk_forward_windows(t, "timestamp", train, test, step)
        a = SP.assign_windows(t, w, "timestamp", train, test, step).select("transaction_id", "window_id", "role")
        b = t.crossJoin(w).where("timestamp >= train_start AND timestamp < test_end").select(
            "transaction_id", "window_id", F.when(F.col("timestamp") < F.col("train_end"), "train").otherwise("test").alias("role"))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_search_draws_and_ranks(spark):
    from pyspark.ml.feature import VectorAssembler
    a, b = L.sampled_settings(50, 1), L.sampled_settings(50, 1)
    assert a == b and set(a[0]) == set(L.SEARCH_SPACE) and len({str(x) for x in a}) == 50
    for d in a:
        for k, v in L.SEARCH_SPACE.items():
            assert d[k] in v if isinstance(v, list) else v[0] <= d[k] <= v[1]
    df = spark.range(240).select(F.col("id").alias("transaction_id"), (F.col("id") % 4 == 0).cast("int").alias("is_fraud"),
                                 F.lit(1.0).alias("weight"), (F.col("id") % 3).cast("int").alias("fold"))
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df.withColumn("x", F.col("is_fraud") + F.rand(1)))
    cv = L.random_search(df, n_trials=2, k=2, space=L.SEARCH_SPACE | {"maxIter": (2, 4), "maxDepth": (2, 3)})
    rows = L.search_results(cv).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2] and max(rows, key=lambda r: r["auc_pr"])["rank"] == 1
    assert "stepSize" in rows[0]["settings"]


def test_registered_backtest_tests_every_day_once(spark, monkeypatch):
    from veloscope.plans import ml_queries
    seen = []
    monkeypatch.setattr(ml_queries, "backtest", lambda txn, out, *days: seen.append(days))
    monkeypatch.setattr(ml_queries, "project", lambda *a: None)
    ml_queries.build()["backtest_fit_orders"].run(spark, SF_SMALL)
    assert seen == [(180, 30, 30)]


def test_rows_are_positioned_once_and_learners_read_encoded_rows(spark, monkeypatch):
    """Split and fold come from one pass over narrow rows, the wide rows are computed once, and fits read vectors, not the encoder."""
    t = txn_events(spark, SF_SMALL)
    ids = lambda d, c: {r[0]: r[1] for r in d.select("transaction_id", c).collect()}
    split, fold = ids(SP.stratified_split(t), "split"), ids(SP.stratified_folds(t, 2), "fold")
    wide, real = [], SP.class_positions
    monkeypatch.setattr(SP, "class_positions", lambda df, *a: wide.append(len(df.columns)) or real(df, *a))
    data = TJ.prepare(t, 2)
    assert wide == [len(t.columns)]
    assert ids(data, "split") == split and ids(data, "fold") == fold
    model = TJ.encoder().fit(data)
    x = TJ.encoded(model, data)
    assert x.columns == ["transaction_id", "is_fraud", "split", "fold", "weight", "stop_on", "features"]
    plain = model.transform(data)
    assert "UDF" not in x._jdf.queryExecution().toString() and x.schema["features"].metadata == plain.schema["features"].metadata
    assert ids(x, "features") == ids(plain, "features")


def test_new_events_are_shuffled_once_and_repeated_ids_stay(spark):
    """The percentile comes with the other windows of the context: no join by id, and no list of amounts where it is not read."""
    first, second = split_by_time(txn_events(spark, SF_SMALL))
    f = fit_features(first)
    alone = f.transform(second)
    assert f.transform(second.unionByName(second)).count() == 2 * second.count()
    assert "collect_list" not in alone.select("transaction_id", "txn_count_24h")._jdf.queryExecution().executedPlan().toString()
    ctx = f.recent.select(second.columns[:8]).withColumn("_new", F.lit(0)).unionByName(second.select(second.columns[:8]).withColumn("_new", F.lit(1)))
    want = {r[0]: r[1] for r in B.spend_percentile(ctx).where("_new = 1").select("transaction_id", "spend_percentile").collect()}
    assert {r[0]: r[1] for r in alone.select("transaction_id", "spend_percentile").collect()} == want


def test_backtest_reads_one_vector_and_bounds_its_tasks(spark):
    """The rows that every fit reads hold their numeric features as one vector, the encoder adds the codes, and tasks grow with the rows slowly."""
    from veloscope.operators import backtest as BT
    from veloscope.sources.transactions import txn_orders
    t = txn_orders(spark, SF_SMALL)
    x = BT.step_features(t, 60)
    assert x.columns == ["transaction_id", "is_fraud", *L.CATEGORICAL, "numeric", "step"]
    got = {r["transaction_id"]: r for r in BT.StepState(x).encoder(0, 500).transform(x).collect()}
    codes = {c: sorted({r[c] for r in got.values()}) for c in L.CATEGORICAL}
    rows = feature_matrix(t, mode="point_in_time").fillna(L.UNKNOWN, list(L.CATEGORICAL)).collect()
    assert len(rows) == len(got)
    for r in rows:
        want = [float(r[n]) for n in L.numeric_features()] + [float(codes[c].index(r[c])) for c in L.CATEGORICAL]
        assert got[r["transaction_id"]]["features"].toArray().tolist() == pytest.approx(want, rel=1e-12)
    assert [BT._tasks(n, 12) for n in (0, 1, 20_001, 600_000, 4_000_000)] == [1, 1, 2, 12, 20]


def test_a_fold_is_read_without_the_others(spark):
    """Encoded rows lie in files of one fold each, rows without a label too, and filters on the fold read no other file."""
    t = txn_events(spark, SF_SMALL).withColumn("is_fraud", F.when(F.col("transaction_id") % 50 != 3, F.col("is_fraud")))
    data = TJ.prepare(t, 3)
    x = TJ.encoded(TJ.encoder().fit(data), data)
    files = x.groupBy(F.input_file_name().alias("f")).agg(F.count_distinct(F.coalesce("fold", F.lit(-1))).alias("n")).collect()
    assert files and all(r["n"] == 1 for r in files)
    ids = lambda d: {r[0]: r[1] for r in d.select("transaction_id", "fold").collect()}
    assert ids(x) == ids(data) and set(ids(x).values()) == {0, 1, 2, None} and x.schema["fold"].dataType == data.schema["fold"].dataType
    plan = x.where("fold <> 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan
