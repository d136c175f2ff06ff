import math
import random

import pytest
from pyspark.sql import functions as F

import veloscope.operators.sliding as S
from tests.conftest import SF_SMALL, txn_rows
from veloscope.operators import temporal as T
from veloscope.sources.transactions import txn_events

ODD = [None, 1.0, -2.5, math.nan, math.inf, -math.inf, 1e21, 1e300, 0.0]


def same(a, b):
    return a == b or (a is not None and b is not None and (a != a and b != b or math.isclose(a, b, rel_tol=1e-9)))


def biggest(v):
    return max(v, key=lambda x: (x != x, x), default=None)


@pytest.mark.parametrize("block", [1, 3, 8])
def test_frames_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rnd = random.Random(block)
    rows = [(rnd.choice(["a", "a", "a", "b"]), rnd.randrange(220), rnd.choice(ODD) if i % 5 == 0 else rnd.random(), rnd.choice("xyzuv"))
            for i in range(300)] + [("c", 5, 1.5, None)]
    d = spark.createDataFrame(rows, "k string, t long, x double, v string")
    widths = {"w1": 1, "w7": 7, "w90": 90, "all": 10_000}
    agg = {(r["k"], r["t"]): r for r in S.sliding_aggregates(d, "k", "t", widths, "x").collect()}
    dist = {(r["k"], r["t"]): r for r in S.sliding_distinct(d, "k", "v", "t", widths).collect()}
    assert set(agg) == set(dist) == {(k, t) for k, t, *_ in rows}
    for (k, t), r in agg.items():
        times = sorted({a for b, a, *_ in rows if b == k})
        assert r["first"] == times[0] and r["prev"] == (times[times.index(t) - 1] if t > times[0] else None)
        for w, us in widths.items():
            frame = [x for x in rows if x[0] == k and t - us < x[1] <= t]
            v = [x[2] for x in frame if x[2] is not None]
            assert r[f"n_{w}"] == len(frame)
            assert same(r[f"s_{w}"], math.fsum(v) if all(map(math.isfinite, v)) else sum(v)), (k, t, w, r[f"s_{w}"], sum(v))
            assert same(r[f"m_{w}"], biggest(v))
            assert dist[k, t][f"d_{w}"] == len({x[3] for x in frame} - {None})


def test_runs_cover_ranges_with_few_aligned_blocks(spark):
    d = spark.createDataFrame([(a, z) for a in range(20) for z in range(a, 40)], "a long, z long")
    for r in d.select("a", "z", S._runs(F.col("a"), F.col("z")).alias("r")).collect():
        got = sorted(b for x in r["r"] for b in range(x["i"] << x["level"], (x["i"] + 1) << x["level"]))
        assert got == list(range(r["a"], r["z"])) and len(r["r"]) <= 2 * max(1, (r["z"] - r["a"]).bit_length())


@pytest.mark.parametrize("odd", [math.inf, math.nan, 1e21, -1e21])
def test_hot_shape_takes_any_amount(spark, odd):
    """One odd amount: the shape for large users gives what the plain one gives, before, while and after it is in a frame."""
    t = txn_events(spark, SF_SMALL).withColumn("amount", F.when(F.col("transaction_id") == 40, F.lit(odd)).otherwise(F.col("amount"))) \
        .withColumn("user_id", F.when(F.col("transaction_id") % 2 == 0, 7).otherwise(F.col("user_id")))
    names = [f"{p}_{h}h" for h in (1, 24, 168) for p in ("txn_count", "amount_sum", "amount_max", "unique_merchants")]
    a, b = ({r["transaction_id"]: r for r in f(t, (1, 24, 168)).collect()} for f in (T.plain_velocity, T.bucketed_velocity_recency))
    assert set(a) == set(b)
    bad = [(i, c, a[i][c], b[i][c]) for i in a for c in names if not same(float(a[i][c]), float(b[i][c]))]
    assert not bad, bad[:4]


def test_edges(spark):
    rows = [(1, 5, 10.0, "m", "a", "2024-01-01T00:00:00", 0), (1, 5, 5.0, "m", "a", "2024-01-01T00:00:00", 0), (2, 5, None, None, "a", "2024-01-01T00:00:00", 0),
            (3, None, 1.0, "m", "a", "2024-01-01T00:00:00", 0), (4, 5, 1.0, "m", "a", None, 0), (5, 5, 2.0, "n", "a", "2024-01-01T01:00:00", 0)]
    d = txn_rows(spark, rows)
    got = T.bucketed_velocity_recency(d, (1,)).collect()
    assert len(got) == len(rows)
    one = lambda i: [r for r in got if r["transaction_id"] == i]
    assert sorted(r["seconds_since_last_txn"] for r in one(1)) == [-1.0, 0.0] and one(2)[0]["seconds_since_last_txn"] == 0.0
    assert {(r["txn_count_1h"], r["amount_sum_1h"], r["amount_max_1h"], r["unique_merchants_1h"]) for r in one(1) + one(2)} == {(3, 15.0, 10.0, 1)}
    assert (one(5)[0]["txn_count_1h"], one(5)[0]["seconds_since_last_txn"]) == (1, 3600.0)         # the lower bound is open
    for r in one(3) + one(4):
        assert (r["txn_count_1h"], r["amount_sum_1h"], r["days_since_first_txn"], r["seconds_since_last_txn"]) == (0, 0.0, 0.0, -1.0)
    assert T.bucketed_velocity_recency(d.limit(0), (1,)).count() == 0 and T.distinct_velocity(d.limit(0), (1,), (("c", "merchant_id"),)).count() == 0


def test_plain_shapes_send_a_large_user_to_the_other_shape(spark, monkeypatch):
    """A user above the threshold is in no window of its own, and every row has the values of the definition."""
    from veloscope.operators import behavioral as B
    from veloscope.operators.skew import DEFAULT_HOT_ROWS
    seen = []
    for module, name in ((T, "bucketed_velocity_recency"), (B, "spend_percentile_distributed")):
        def spy(df, *a, f=getattr(module, name), name=name, **kw):
            seen.append((name, {r["user_id"] for r in df.select("user_id").distinct().collect()}))
            return f(df, *a, **kw)
        monkeypatch.setattr(module, name, spy)
    n = DEFAULT_HOT_ROWS + 500
    i = F.col("id")
    t = spark.range(n + 40).select(
        i.alias("transaction_id"), F.when(i < n, 1).when(i < n + 20, 2).cast("long").alias("user_id"), (-i).cast("double").alias("amount"),
        (i % 3).cast("string").alias("merchant_id"), F.timestamp_seconds(i * 600).alias("timestamp"))
    v = T.plain_velocity(t, (24,)).collect()
    p = B.spend_percentile(t).collect()
    assert seen == [("bucketed_velocity_recency", {1}), ("spend_percentile_distributed", {1})]
    at = lambda x: x if x < n else x - n
    known = {k: min(at(k) + 1, 144) for k in range(n + 20)}
    assert {r["transaction_id"]: r["txn_count_24h"] for r in v} == known | {k: 0 for k in range(n + 20, n + 40)}
    assert {r["transaction_id"]: r["unique_merchants_24h"] for r in v} == {k: min(c, 3) for k, c in known.items()} | {k: 0 for k in range(n + 20, n + 40)}
    assert all(r["spend_percentile"] == (1 / (at(r["transaction_id"]) + 1) if r["user_id"] else 0.5) for r in p) and len(p) == n + 40


def test_only_frames_across_partitions_are_asked_for(spark, monkeypatch):
    """Rows go to range partitions once, whatever the number of widths; running counts see the keys of several partitions only."""
    parts, counted = [], []
    monkeypatch.setattr(S, "range_parts", lambda d, *a, f=S.range_parts: parts.append(d.count()) or f(d, *a))
    monkeypatch.setattr(S, "running_sums", lambda d, *a, f=S.running_sums, **kw: counted.append(d.count()) or f(d, *a, **kw))
    d = spark.range(4000).select((F.col("id") % 200).alias("k"), F.col("id").alias("t"), (F.col("id") % 3).cast("string").alias("v"), F.lit(1.0).alias("x"))
    widths = {"short": 300, "mid": 1000, "long": 10_000}
    got = S.sliding(d, "k", "t", widths, "x", (("d", "v"),)).collect()
    assert parts == [4000, 4000] and sum(counted) < 2000
    assert {(r["k"], r["t"]) for r in got} == {(i % 200, i) for i in range(4000)}
    for r in got:
        for w, us in widths.items():
            frame = range(r["t"], max(-1, r["t"] - us), -200)
            assert (r[f"n_{w}"], r[f"s_{w}"], r[f"d_{w}"]) == (len(frame), float(len(frame)), len({i % 3 for i in frame}))
