import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

import veloscope.operators.point_in_time as P
from tests.conftest import SF_SMALL, txn_rows
from veloscope.operators.features import feature_matrix
from veloscope.sources.transactions import txn_events


def med(v):
    if not v:
        return None
    v = sorted(v, key=lambda x: (x != x, x))
    a, z = v[(len(v) - 1) // 2], v[len(v) // 2]
    return (a + z) / 2


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (a != a and b != b)))


@pytest.mark.parametrize("block", [1, 4, 16])
def test_running_median_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rnd = random.Random(block)
    series = {"up": [float(i) for i in range(150)], "down": [float(-i) for i in range(150)], "tied": [7.0] * 90,
              "random": [rnd.choice([rnd.random(), 3.0]) for _ in range(170)],
              "ends first": [float(x) for i in range(70) for x in (-100 - i, 100 + i)] + [rnd.uniform(-1, 1) for _ in range(80)],
              "odd": [math.nan, math.inf, 1.0, -math.inf, math.nan, 2.0, 5.0, math.nan, 1e300, 4.0] * 6, "one": [3.5]}
    rows = [(k, i, x, len(v)) for k, v in series.items() for i, x in enumerate(v)]
    got = {(r["k"], r["m"]): r["median"] for r in
           P.running_median(spark.createDataFrame(rows, "k string, m long, x double, of long"), "k", "x").collect()}
    assert len(got) == sum(len(v) + 1 for v in series.values())
    bad = [(k, m, got[k, m], med(v[:m])) for k, v in series.items() for m in range(len(v) + 1) if not same(got[k, m], med(v[:m]))]
    assert not bad, bad[:5]


def test_states_over_partitions(spark):
    rnd, rows = random.Random(2), []
    for i in range(900):                    # one user holds most rows, days repeat across partitions, some rows are undated
        day = None if i % 41 == 0 else i // 70
        rows.append((i, 1 if i % 5 else 2, rnd.choice([None, 1e9 + rnd.random(), rnd.random()]), day, 1))
    d = spark.createDataFrame(rows, "i long, u long, x double, day int, one long").withColumn("day", F.date_add(F.lit("2024-01-01"), "day"))
    got = {r["i"]: r for r in P.running_states(d.withColumn("t", F.when(F.col("day").isNotNull(), F.col("i"))), "u", ["t", "i"], "x", "day", ["one"]).collect()}
    for u in (1, 2):
        mine = sorted((r for r in rows if r[1] == u), key=lambda r: (r[3] is None, r[0]))
        for at, r in enumerate(mine):
            before, g = mine[:at], got[r[0]]
            x = [b[2] for b in before if b[2] is not None]
            assert g["p_one"] == at and g["p_n"] == len(x) and g["p_days"] == len({b[3] for b in before} - {None})
            if x:
                assert math.isclose(g["p_mean"], statistics.fmean(x), rel_tol=1e-9)
                assert math.isclose(g["p_m2"], sum((a - statistics.fmean(x)) ** 2 for a in x), rel_tol=1e-6, abs_tol=1e-3)


def test_later_rows_change_nothing(spark):
    t = txn_events(spark, SF_SMALL)
    cut = t.agg(F.expr("percentile(unix_micros(timestamp), 0.5)")).first()[0]
    names = ["amount_vs_user_avg", "amount_vs_user_median", "user_txn_count", "avg_daily_spend", "is_new_merchant", "amount_zscore",
             "category_frequency_ratio", "spend_percentile", "txn_count_168h"]
    early = t.where(F.unix_micros("timestamp") <= F.lit(cut))
    rows = lambda d: {r[0]: [round(float(x), 9) for x in r[1:]] for r in d.select("transaction_id", *names).collect()}
    alone, whole = rows(feature_matrix(early, mode="point_in_time")), rows(feature_matrix(t, mode="point_in_time"))
    assert alone and all(whole[i] == v for i, v in alone.items())


def test_edges(spark):
    rows = [(1, 5, 10.0, "m", "a", "2024-01-01T00:00:00", 0), (2, 5, None, "m", "a", "2024-01-01T00:00:00", 0), (3, 5, 30.0, None, None, None, 0),
            (4, 5, 20.0, "n", "a", "2024-01-02T00:00:00", 0), (4, 5, 20.0, "n", "a", "2024-01-02T00:00:00", 0), (6, None, 1.0, "m", "a", "2024-01-01T00:00:00", 0),
            (7, 9, float("inf"), "m", "a", "2024-01-01T00:00:00", 0), (8, 9, 1e21, "m", "a", "2024-01-03T00:00:00", 0)]
    d = txn_rows(spark, rows)
    got = sorted(P.point_in_time_profile(d).collect(), key=lambda r: (r["user_id"] or 0, r["timestamp"] is None, str(r["timestamp"]), r["transaction_id"]))
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["transaction_id"], []).append(r)
    assert by[6][0]["_u_count"] is None and by[6][0]["_um_count"] is None
    assert (by[1][0]["_u_count"], by[1][0]["_u_mean"], by[1][0]["_u_median"], by[1][0]["_um_count"]) == (0, None, None, 0)
    assert (by[2][0]["_u_mean"], by[2][0]["_u_days"], by[2][0]["_um_count"], by[2][0]["_uc_count"]) == (10.0, 1, 1, 1)
    assert sorted(r["_u_count"] for r in by[4]) == [2, 3] and sorted(r["_um_count"] for r in by[4]) == [0, 1]
    last = by[3][0]
    assert (last["_u_count"], last["_u_median"], last["_u_days"], last["_um_count"], last["_u_spend"]) == (4, 20.0, 2, None, 50.0)
    assert by[8][0]["_u_mean"] == math.inf and by[8][0]["_u_median"] == math.inf
    assert P.point_in_time_profile(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        feature_matrix(d, mode="later")


def test_hot_and_plain_shape_are_equal(spark):
    t = txn_events(spark, SF_SMALL)
    rows = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.collect())
    assert rows(feature_matrix(t, mode="point_in_time", hot_threshold=0)) == rows(feature_matrix(t, mode="point_in_time", hot_threshold=None))


def test_plain_and_distributed_profiles_are_equal(spark, monkeypatch):
    rnd, rows = random.Random(4), []
    for i in range(400):                    # ties, repeated and missing ids, undated rows, odd amounts, rows without user, category or merchant
        rows.append((None if i % 37 == 0 else i // 2 if i % 11 == 0 else i, rnd.choice([1, 1, 1, 2, 3, None]),
                     rnd.choice([None, 5.0, rnd.random(), 1e21, math.inf, math.nan] if i > 200 else [None, rnd.random(), 7.0]),
                     rnd.choice(["m", "n", "o", None]), rnd.choice(["a", "b", None]),
                     None if i % 29 == 0 else f"2024-01-{1 + i % 9:02d}T{rnd.choice([2, 12]):02d}:00:00", 0, rnd.choice(["x", "y", None])))
    d = txn_rows(spark, rows, ", device_fingerprint string").coalesce(1)
    plain = P.plain_profile(P.with_micros(d).withColumns({P.RID: F.monotonically_increasing_id(), "is_night": F.coalesce(P.C.is_night("timestamp"), F.lit(0))}))
    names = sorted(c for c in P.point_in_time_profile(d).columns if c.startswith("_u"))
    of = lambda x: sorted(([repr(v) for v in r[:7]], list(r[7:])) for r in x.select(
        "transaction_id", "user_id", "amount", "merchant_id", "merchant_category", F.col("timestamp").cast("string"), "device_fingerprint",
        "_u_rows", *[c for c in names if c != "_u_rows"]).collect())
    a, b = of(P.point_in_time_profile(d)), of(plain)
    assert [x[0] for x in a] == [x[0] for x in b]
    assert not [(x, y) for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x[1], y[1]))]

    def only_plain(*_):
        raise AssertionError("small users take no distributed profile")
    with monkeypatch.context() as m:
        m.setattr(P, "point_in_time_profile", only_plain)
        small = feature_matrix(d, mode="point_in_time")
        assert small.count() == 400
    monkeypatch.setattr(P, "PLAIN_ROWS", 100)           # user 1 is above, the others are not
    rows = lambda x: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in x.where("amount < 1e20").collect())
    assert rows(feature_matrix(d, mode="point_in_time")) == rows(small)


def test_a_large_user_takes_no_plain_profile_without_detection(spark, monkeypatch):
    """``hot_threshold=None`` routes no user to the bucketed windows; the plain profile, quadratic in a user's rows, keeps its bound."""
    rnd = random.Random(7)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, rnd.random(), 7.0]), rnd.choice("mno"), rnd.choice("ab"),
             None if i % 29 == 0 else f"2024-01-{1 + i % 9:02d}T12:00:00", 0) for i in range(300)]
    d = txn_rows(spark, rows).coalesce(1)
    got = lambda: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in feature_matrix(
        d, groups=("behavioral", "transaction"), mode="point_in_time", hot_threshold=None).collect())
    plain, seen = got(), []
    monkeypatch.setattr(P, "PLAIN_ROWS", 100)
    monkeypatch.setattr(P, "plain_profile", lambda x, *a, f=P.plain_profile: seen.append({r[0] for r in x.select("user_id").distinct().collect()}) or f(x, *a))
    assert got() == plain and seen == [{2, 3, None}]
