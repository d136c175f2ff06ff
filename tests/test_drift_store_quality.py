"""Drift, TTL counter, contract and split edges."""
import pytest
from pyspark.sql import functions as F

from tests.conftest import txn_rows
from veloscope.operators import drift as D
from veloscope.operators import quality as Q
from veloscope.operators import splits as SP
from veloscope.operators import store as ST


def test_identical_data_has_no_drift(spark):
    df = spark.range(500).select((F.col("id") % 97).cast("double").alias("x"))
    per, summ = D.drift_report(df, df, ["x"])
    r = per.first()
    assert r["psi"] == 0.0 and r["ks_statistic"] == 0.0 and r["drifted"] == 0
    assert summ.first()["overall_drifted"] == 0


def test_shift_is_drift_and_small_current_is_skipped(spark):
    ref = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"), F.lit(1.0).alias("c"))
    cur = spark.range(200).select((F.col("id") % 100 + 300).cast("double").alias("x"),
                                  F.when(F.col("id") < 29, 1.0).alias("c"))
    per, summ = D.drift_report(ref, cur, ["x", "c"])
    rows = {r["feature"]: r for r in per.collect()}
    assert rows["x"]["drifted"] == 1 and rows["x"]["psi_band"] == "significant"
    assert "c" not in rows  # 29 current values < 30
    s = summ.first()
    assert s["total_features_checked"] == 2 and s["drifted_feature_count"] == 1


def test_ttl_counter_edges(spark):
    rows = [(i, 1, 1.0, "m", "a", f"2024-01-01T{h}", 0)
            for i, h in enumerate(["00:00:00", "01:00:00", "01:59:59", "03:00:00"], 1)]
    out = ST.session_counter(txn_rows(spark, rows), 60).orderBy("transaction_id")
    assert [r["counter_60m"] for r in out.collect()] == [1, 1, 2, 1]
    lk = ST.velocity_lookup(txn_rows(spark, rows), windows=[60]).orderBy("transaction_id")
    assert [r["velocity_60m"] for r in lk.collect()] == [0.0, 0.0, 1.0, 0.0]


def test_contract_edges(spark):
    schema = "transaction_id string, user_id string, amount double, currency string, merchant_id string, " \
             "merchant_category string, payment_method string, country string, latitude double"
    rows = [("a", "u", 0.0, "usd", "m", None, None, "US", 0.0),
            ("b", "u", 0.005, "usd", "m", None, None, "US", 0.0),
            ("c", "u", 1e6, "USDD", "m", "other", None, "U", 91.0),
            ("d", "u", 1e6 + 0.01, "usd", "m", "unknown_cat", None, "US", 0.0)]
    ok, bad = Q.contract_split(spark.createDataFrame(rows, schema))
    assert [r["transaction_id"] for r in ok.collect()] == ["b"]
    errs = {r["transaction_id"]: r["contract_errors"] for r in bad.collect()}
    assert errs["a"] == ["amount range"]
    assert set(errs["c"]) == {"currency length", "country length", "latitude range"}
    assert set(errs["d"]) == {"amount range", "merchant_category enum"}


def test_validation_report_counts(spark):
    rows = [(1, 1, 5.0, "m", "a", "2024-01-01T00:00:00", 0), (1, None, 0.0, "m", "a", "2024-01-01T00:00:00", 1),
            (None, 2, None, "m", "a", "2024-01-01T00:00:00", 0)]
    r = Q.validation_report(txn_rows(spark, rows)).first()
    assert r["n_rows"] == 3 and r["n_null_txn_id"] == 1 and r["n_bad_amount"] == 1 and r["n_null_amount"] == 1
    assert r["n_duplicate_ids"] == 1 and r["passed"] == 0 and r["n_rows_valid"] == 1


def test_split_is_exact_per_class(spark):
    df = spark.range(1000).select(F.col("id").alias("transaction_id"),
                                  (F.col("id") % 10 == 0).cast("int").alias("is_fraud"))
    s = {(r["is_fraud"], r["split"]): r["count"] for r in SP.stratified_split(df).groupBy("is_fraud", "split").count()
         .collect()}
    assert s[(1, "test")] == 15 and s[(0, "test")] == 135
    folds = SP.stratified_folds(df).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [200] * 5


def test_ip_risk_mask_and_input_check(spark):
    from veloscope.operators import transaction as X
    ev = spark.createDataFrame([("t1", "7", "10.1.2.3"), ("t2", "8", None)],
                               "transaction_id string, user_id string, ip_address string")
    risk = spark.createDataFrame([("10.1.2.3", 0.9, True)], "ip_address string, ip_risk_score double, vpn_detected boolean")
    r = {x["transaction_id"]: x for x in X.ip_risk(ev, risk).collect()}
    assert r["t1"]["ip_risk_score"] == 0.9 and r["t1"]["vpn_detected"] == 1
    assert r["t2"]["ip_risk_score"] == 0.0 and r["t2"]["vpn_detected"] == 0
    m = {x["transaction_id"]: x for x in X.mask_pii(ev, salt="s").collect()}
    assert m["t1"]["ip_address"] == "10.1.x.x" and len(m["t1"]["user_id"]) == 64
    with pytest.raises(ValueError, match="columns absent"):
        Q.check_input(ev)
    rows = [(1, 1, 5.0, "m", "a", "2024-01-01T00:00:00", 0)]
    with pytest.raises(ValueError, match="no rows"):
        Q.check_input(txn_rows(spark, rows).limit(0))
    Q.check_input(txn_rows(spark, rows))
