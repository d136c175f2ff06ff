"""Every registered query with an oracle agrees with DuckDB on the same tables (sf0.001)."""
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

SQL = E.oracle_sql()
# slow fits, and the backtest whose windows are all too small on these tables: tests/test_training.py has their values
SLOW = {"model_comparison_orders", "training_job_orders", "feature_importance_orders", "backtest_fit_orders",
        "settings_search_orders"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], SQL[name], SF_SMALL)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(SQL) - SLOW))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_id", "n_txn", "peak_txn_24h", "peak_spend_24h", "max_amount_zscore",
                          "n_amount_outliers", "max_score", "risk_tier"]
