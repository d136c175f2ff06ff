import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from veloscope.session import get_session
    s = get_session("local[4]", 8, extra={"spark.ui.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veloscope-test-ckpt-"))
    yield s


def ts(s):
    import datetime as dt
    return dt.datetime.fromisoformat(s)


def txn_rows(spark, rows, extra_schema=""):
    """rows: (transaction_id, user_id, amount, merchant_id, merchant_category, timestamp-iso, is_fraud, ...)."""
    schema = ("transaction_id long, user_id long, amount double, merchant_id string, merchant_category string, "
              "timestamp timestamp, is_fraud int" + extra_schema)
    data = [tuple(ts(v) if i == 5 and isinstance(v, str) else v for i, v in enumerate(r)) for r in rows]
    from pyspark.sql import functions as F
    return spark.createDataFrame(data, schema).withColumn("currency", F.lit("USD"))
