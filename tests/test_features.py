"""Hand-computed edge rows for the temporal / behavioural features and the two physical shapes."""
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, txn_rows
from veloscope.operators.features import feature_matrix
from veloscope.sources.transactions import txn_orders

H = "2024-01-01T"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        # user 1: exactly 1 h apart, then 1 h minus 1 us, then an equal timestamp
        (1, 1, 10.0, "m1", "a", H + "00:00:00", 0),
        (2, 1, 20.0, "m2", "a", H + "01:00:00", 0),
        (3, 1, 30.0, "m1", "b", H + "01:59:59.999999", 1),
        (4, 1, 40.0, "m3", "b", H + "01:59:59.999999", 0),
        # single-row user
        (5, 2, 5.0, "m1", "a", H + "03:00:00", 0),
        # null amount and null merchant
        (6, 3, None, None, "a", H + "04:00:00", 0),
        (7, 3, 7.0, "m1", None, H + "04:30:00", 0),
        # null user
        (8, None, 9.0, "m1", "a", H + "05:00:00", 0),
    ]
    return txn_rows(spark, rows)


def _by_id(df):
    return {r["transaction_id"]: r for r in df.collect()}


@pytest.mark.parametrize("hot", [None, 0])
def test_velocity_edges(edges, hot):
    r = _by_id(feature_matrix(edges, hot_threshold=hot))
    # (t - 1h, t]: the row exactly 1 h earlier is out, equal timestamps are in
    assert r[2]["txn_count_1h"] == 1
    assert r[3]["txn_count_1h"] == 3 and r[4]["txn_count_1h"] == 3
    assert r[3]["amount_sum_1h"] == pytest.approx(90.0)
    assert r[3]["unique_merchants_1h"] == 3
    assert r[4]["txn_count_24h"] == 4 and r[4]["amount_max_24h"] == 40.0
    assert r[5]["txn_count_1h"] == 1 and r[5]["spend_percentile"] == 0.5
    # null amount: counted, sum/max skip it; null merchant not a distinct merchant
    assert r[6]["txn_count_1h"] == 1 and r[6]["amount_sum_1h"] == 0.0 and r[6]["amount_max_1h"] == 0.0
    assert r[7]["txn_count_1h"] == 2 and r[7]["unique_merchants_1h"] == 1
    # null user: no user statistics at all
    assert r[8]["txn_count_1h"] == 0 and r[8]["user_txn_count"] == 0 and r[8]["spend_percentile"] == 0.5
    # recency: first row -1, ties 0
    assert r[1]["seconds_since_last_txn"] == -1.0
    assert r[2]["seconds_since_last_txn"] == 3600.0
    assert r[4]["seconds_since_last_txn"] == 0.0
    assert r[4]["days_since_first_txn"] == pytest.approx((2 * 3600 - 1e-6) / 86400)


def test_behavioral_edges(edges):
    r = _by_id(feature_matrix(edges, hot_threshold=None))
    assert r[1]["user_txn_count"] == 4
    assert r[1]["category_frequency_ratio"] == pytest.approx(2 / (4 + 1e-8))
    assert r[7]["is_new_category"] == 0  # null category → 0
    assert r[1]["is_new_merchant"] == 0 and r[2]["is_new_merchant"] == 1
    # expanding percentile in (time, id) order: 10 → 1/1, 20 → 2/2, 30 → 3/3, 40 → 4/4
    assert [r[i]["spend_percentile"] for i in (1, 2, 3, 4)] == [1.0, 1.0, 1.0, 1.0]
    # single-row user: std null → 1 in the z-score denominator
    assert r[5]["amount_zscore"] == 0.0
    assert r[1]["avg_daily_spend"] == pytest.approx(100.0)


def test_percentile_orders(spark):
    rows = [(i, 1, float(a), "m", "a", f"2024-01-0{i}T00:00:00", 0) for i, a in enumerate([50, 40, 30, 60], 1)]
    r = _by_id(feature_matrix(txn_rows(spark, rows), hot_threshold=None))
    assert [r[i]["spend_percentile"] for i in (1, 2, 3, 4)] == [1.0, 0.5, 1 / 3, 1.0]


def test_hot_shape_equals_plain_shape(spark):
    from veloscope.sources.transactions import txn_orders
    from tests.conftest import SF_SMALL
    t = txn_orders(spark, SF_SMALL)
    a = {r["transaction_id"]: r.asDict() for r in feature_matrix(t, hot_threshold=None).collect()}
    b = {r["transaction_id"]: r.asDict() for r in feature_matrix(t, hot_threshold=0).collect()}
    assert a.keys() == b.keys()
    for k, row in a.items():
        for c, x in row.items():
            # the shapes sum in different orders: doubles agree to 1e-9 relative
            assert x == pytest.approx(b[k][c], rel=1e-9, abs=1e-12) if isinstance(x, float) else x == b[k][c], (k, c)


def test_counts_monotone_in_window(spark):
    from veloscope.sources.transactions import txn_events
    from tests.conftest import SF_SMALL
    fm = feature_matrix(txn_events(spark, SF_SMALL), hot_threshold=None)
    bad = fm.where((F.col("txn_count_1h") > F.col("txn_count_6h")) | (F.col("txn_count_6h") > F.col("txn_count_24h"))
                   | (F.col("txn_count_24h") > F.col("txn_count_168h")))
    assert bad.count() == 0
    assert fm.count() == txn_events(spark, SF_SMALL).count()
    assert len([c for c in fm.columns if c not in ("transaction_id", "user_id", "merchant_id", "timestamp",
                                                    "is_fraud")]) == 48


def test_distance_from_home_shapes_agree(spark):
    from veloscope.operators.transaction import distance_from_home
    from veloscope.sources.transactions import txn_orders
    from tests.conftest import SF_SMALL
    t = txn_orders(spark, SF_SMALL).withColumns({
        "latitude": (F.col("amount") % 90).cast("double"), "longitude": (F.col("transaction_id") % 180).cast("double")})
    a = {r["transaction_id"]: r["distance_from_home"] for r in distance_from_home(t, hot_threshold=10**9).collect()}
    b = {r["transaction_id"]: r["distance_from_home"] for r in distance_from_home(t, hot_threshold=0).collect()}
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9) for k in a)


def test_one_user_with_a_third_of_all_rows(spark):
    """Skew: a third of the orders move to one user; only that user is routed to the hot shape
    and the mixed result equals the plain computation."""
    from veloscope.operators.skew import split_hot
    from veloscope.sources.transactions import txn_orders
    from tests.conftest import SF_SMALL
    t = txn_orders(spark, SF_SMALL).withColumn(
        "user_id", F.when(F.col("transaction_id") % 3 == 0, F.lit(10**9)).otherwise(F.col("user_id")))
    n = t.count()
    split = split_hot(t, ["user_id"], threshold=n // 10)
    assert split.n_hot_keys == 1
    assert split.hot.select("user_id").distinct().collect()[0][0] == 10**9
    a = {r["transaction_id"]: r.asDict() for r in feature_matrix(t, hot_threshold=None).collect()}
    b = {r["transaction_id"]: r.asDict()
         for r in feature_matrix(t, hot_threshold=n // 10).collect()}
    assert a.keys() == b.keys() and len(a) == n
    for k, row in a.items():
        for c, x in row.items():
            assert x == pytest.approx(b[k][c], rel=1e-9, abs=1e-12) if isinstance(x, float) else x == b[k][c], (k, c)


@pytest.mark.parametrize("mode", ["full", "point_in_time"])
def test_tasks_of_the_windows_hold_a_bounded_number_of_rows(spark, monkeypatch, mode):
    """The partitions of the window chain grow with the rows, whatever the session's number is; the values stay."""
    from tests.conftest import SF_SMALL
    from veloscope.operators import skew
    from veloscope.sources.transactions import txn_orders
    t = txn_orders(spark, SF_SMALL)
    before = feature_matrix(t, mode=mode)
    expected = sorted(map(str, before.collect()))
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    n = -(-t.count() // 50)
    after = feature_matrix(t, mode=mode)
    assert n > 8 >= before.rdd.getNumPartitions() and after.rdd.getNumPartitions() == n
    assert sorted(map(str, after.collect())) == expected


@pytest.mark.parametrize("mode", ["full", "point_in_time"])
def test_adaptive_execution_does_not_merge_the_tasks_of_the_windows(spark, monkeypatch, mode):
    """With more shuffle partitions than the windows need, their tasks still hold a bounded number of rows; the values stay."""
    from tests.conftest import SF_SMALL
    from veloscope.operators import skew
    from veloscope.sources.transactions import txn_events
    t = txn_events(spark, SF_SMALL)
    expected = sorted(map(str, feature_matrix(t, mode=mode).collect()))
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    n = -(-t.count() // 50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        after = feature_matrix(t, mode=mode)
        sizes = after.rdd.glom().map(len).collect()
        got = sorted(map(str, after.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 4 < n < 200 and len(sizes) == n
    assert got == expected


def test_hot_shape_shuffles_wide_rows_once_and_keeps_only_its_results(spark):
    """Each step's tables go with the step, and the wide rows meet the results in joins by row."""
    import os
    from urllib.parse import urlparse
    from veloscope.session import checkpoint_dir
    folder = urlparse(checkpoint_dir(spark)).path
    before = set(os.listdir(folder))
    t = txn_orders(spark, SF_SMALL)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = feature_matrix(t, hot_threshold=0)
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == ["hot-keys", "percentile", "profile", "rows", "velocity"]
    deals = [line for line in plan.splitlines() if "Exchange" in line]
    assert sum("hashpartitioning(_rid" in line for line in deals) == 4 and not any("merchant" in line for line in deals), deals
    assert d.count() == t.count()


def test_written_alone_removes_what_was_written_on_the_way(spark):
    import os
    from urllib.parse import urlparse
    from veloscope import session as S
    folder = urlparse(S.checkpoint_dir(spark)).path
    before = set(os.listdir(folder))
    kept = S.written_once(spark.range(10), "kept")

    def build():
        inner = S.written_alone(lambda: S.cut_lineage(kept.where("id > 2")).where("id < 8"), "inner")
        return S.written_once(inner.withColumn("x", F.col("id") * 2), "passing").where("x > 6")

    out = S.written_alone(build, "outer")
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == ["kept", "outer"]
    assert sorted(r["x"] for r in out.collect()) == [8, 10, 12, 14] and kept.count() == 10
    with pytest.raises(ZeroDivisionError):
        S.written_alone(lambda: 1 / 0, "failed")
    assert S._passing.tables is None
