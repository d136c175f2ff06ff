from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veloscope.operators import drift as D


def brute(n, m, gap):
    """All orders of n and m values, counted."""
    far = total = 0
    for ref in combinations(range(n + m), n):
        at = np.isin(np.arange(n + m), ref)
        far += np.abs(np.cumsum(at) * m - np.cumsum(~at) * n).max() >= gap
        total += 1
    return far / total


@pytest.mark.parametrize("n,m", [(1, 1), (3, 5), (6, 6), (7, 4), (8, 6)])
def test_lattice_paths_against_all_orders(n, m):
    for gap in range(0, n * m + 2):
        assert D.exact_pvalue(n, m, gap) == pytest.approx(brute(n, m, gap) if gap else 1.0, abs=1e-12)


def test_large_samples_near_the_series(spark):
    """At the largest exact sizes both distributions agree to a few per cent, and the exact one stays a probability."""
    n = m = 3000
    d = spark.createDataFrame([(g,) for g in (60, 90, 120)], "gap long").select(F.col("gap"), (F.col("gap") / n).alias("d"))
    far = {r["gap"]: r["p"] for r in d.select("gap", D.ks_pvalue(F.col("d"), F.lit(float(n)), F.lit(float(m))).alias("p")).collect()}
    for gap, p in far.items():
        assert D.exact_pvalue(n, m, gap * m) == pytest.approx(p, rel=0.05)


def test_rule_ties_and_one_sided_features(spark):
    rows = [("a", float(x), s) for s, xs in ((0, [1, 2, 2, 3, 9]), (1, [2, 2, 4, 5])) for x in xs] + [("only ref", 1.0, 0)] + \
        [("same", float(x), s) for s in (0, 1) for x in range(6)]
    v = D.value_table(spark.createDataFrame(rows, "feature string, x double, side int"))
    got = {r["feature"]: r for r in D.ks_test(v).collect()}
    assert set(got) == {"a", "same"} and got["same"]["ks_pvalue"] == 1.0 and got["same"]["ks_statistic"] == 0.0
    gap = max(abs(i * 4 - j * 5) for i, j in ((1, 0), (3, 2), (4, 2), (4, 3), (4, 4)))
    assert got["a"]["ks_pvalue"] == pytest.approx(brute(5, 4, gap)) and got["a"]["ks_statistic"] == pytest.approx(gap / 20)
    far = {r["feature"]: r["ks_pvalue"] for r in D.ks_test(v, exact_up_to=4).collect()}
    assert far["a"] != got["a"]["ks_pvalue"]
    ref, cur = (spark.range(40).select((F.col("id") * k).cast("double").alias("x")) for k in (1.0, 1.4))
    exact, plain = (D.drift_report(ref, cur, ["x"], p_value=p)[0].first() for p in ("auto", "asymptotic"))
    assert exact["ks_statistic"] == plain["ks_statistic"] and 0 < abs(exact["ks_pvalue"] - plain["ks_pvalue"]) < 0.05
