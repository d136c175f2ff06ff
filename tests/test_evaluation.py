"""Score edges: perfect, ties, empty classes, threshold at infinity, identities."""
import math

import pytest

from veloscope.operators import evaluation as EV


def _eval(spark, ys, ps):
    df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(zip(ys, ps))],
                               "transaction_id long, is_fraud int, score double")
    return EV.evaluate(df).first()


def test_perfect(spark):
    m = _eval(spark, [0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.7, 0.8, 0.9])
    assert m["auc_roc"] == 1.0 and m["auc_pr"] == 1.0 and m["ks_statistic"] == 1.0
    assert m["optimal_threshold"] == 0.7 and m["f1_optimal"] == 1.0
    assert m["gini"] == pytest.approx(2 * m["auc_roc"] - 1)


def test_all_ties(spark):
    m = _eval(spark, [0, 1, 0, 1], [0.5, 0.5, 0.5, 0.5])
    assert m["auc_roc"] == 0.5 and m["auc_pr"] == 0.5
    assert math.isinf(m["optimal_threshold"])  # J = 0 everywhere → flag nothing


def test_no_positives(spark):
    m = _eval(spark, [0, 0, 0], [0.1, 0.5, 0.9])
    assert m["auc_roc"] is None and m["ks_statistic"] == 0.0
    assert m["fraud_catch_rate_top1pct"] == 0.0


def test_reversed_scorer(spark):
    m = _eval(spark, [1, 1, 0, 0], [0.1, 0.2, 0.8, 0.9])
    assert m["auc_roc"] == 0.0 and math.isinf(m["optimal_threshold"])


def test_catch_rate_ties_by_id(spark):
    # top 20 % of 10 rows = 2 rows; ties on 0.9 broken by id → ids 0 and 1
    ys = [1, 0, 1, 0, 0, 0, 0, 0, 0, 0]
    m = _eval(spark, ys, [0.9, 0.9, 0.9] + [0.1] * 7)
    assert m["fraud_catch_rate_top20pct"] == 0.5


def test_threshold_table_shape(spark):
    df = spark.createDataFrame([(i, i % 2, i / 10) for i in range(10)], "transaction_id long, is_fraud int, score double")
    t = EV.threshold_table(df).collect()
    assert len(t) == 20 and t[0]["threshold"] == pytest.approx(0.1) and t[-1]["threshold"] == pytest.approx(0.95)
