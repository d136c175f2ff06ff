"""Running totals over range partitions: any order type, nulls, balance; look-backs; plan bounds."""
import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veloscope.operators import drift as D
from veloscope.operators.prefix import PART, ordered, preceding_rows, range_parts, running_sums
from veloscope.sources.transactions import txn_events


def plain(df, by, order, col, desc, tie):
    w = Window.partitionBy(*by).orderBy(ordered(order, desc), ordered(tie)).rowsBetween(Window.unboundedPreceding, 0)
    return {r["id"]: (r["run"], r["tot"]) for r in df.withColumn("run", F.sum(col).over(w)).withColumn(
        "tot", F.sum(col).over(Window.partitionBy(*by))).collect()}


def test_equals_the_plain_window(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.random()]), rng.choice(["x", "yy", "z", None]) or None, rng.randint(0, 9))
            for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, x double, s string, v long")
    for order in ("x", "s", "v"):
        for desc in (False, True):
            for by in (["g"], []):
                got = {r["id"]: (r["run_v"], r["tot_v"]) for r in running_sums(df, by, order, ["v"], descending=desc, tiebreak=["id"]).collect()}
                assert got == plain(df, by or [F.lit(0)], order, "v", desc, "id"), (order, desc, by)


def test_partitions_are_balanced(spark):
    """A lognormal value with outliers: equal-width bins would put nearly all rows into one."""
    df = spark.range(200_000).withColumn("x", F.exp(F.randn(3) * 2)).withColumn("x", F.when(F.col("id") == 7, 1e9).otherwise(F.col("x")))
    sizes = [r["count"] for r in range_parts(df, [], [F.col("x")]).groupBy(PART).count().collect()]
    assert len(sizes) >= 7 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_rows_before(spark):
    df = spark.createDataFrame([(i, float((i * 7) % 11)) for i in range(300)], "t long, v double")
    got = {r["t"]: r for r in preceding_rows(df, "t", 5, {"m": lambda w: F.avg("v").over(w), "n": lambda w: F.count("v").over(w)}, block=16).collect()}
    assert len(got) == 300
    for t, r in got.items():
        before = [float((i * 7) % 11) for i in range(max(0, t - 5), t)]
        assert r["n"] == len(before) and (not before or math.isclose(r["m"], sum(before) / len(before)))


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_drift_reads_its_value_table(spark):
    """After the value table is written, the report plans neither the events again nor a join of events."""
    per, _ = D.drift_by_time(txn_events(spark, SF_SMALL), ["amount", "score"])
    plan = executed(per)
    assert "events.parquet" not in plan and "NestedLoop" not in plan


def test_window_assignment_has_no_nested_loop(spark):
    from veloscope.operators import splits as SP
    from veloscope.sources.transactions import txn_orders
    t = txn_orders(spark, SF_SMALL)
    plan = executed(SP.assign_windows(t, SP.walk_forward_windows(t)))
    assert plan.count("NestedLoopJoin") <= 2                 # the one-row origin (initial and final plan)


def test_frame_sums_equal_range_windows(spark):
    from veloscope.operators.prefix import frame_sums
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randint(0, 60), rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v long")
    got = frame_sums(df, "k", "t", {"w": (-10, 0), "past": (-11, -1)}, ["v"]).collect()
    for r in got:
        assert r["w_v"] == sum(v for _, k, t, v in rows if k == r["k"] and r["t"] - 10 < t <= r["t"])
        assert r["past_v"] == sum(v for _, k, t, v in rows if k == r["k"] and r["t"] - 10 <= t < r["t"])
    assert len(got) == 300
