import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import veloscope.llm.hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, row long, id string"


def brute(rows, anchor, n_pos=5, n_neg=5, low=80):
    """rows: (id, vector, label), every row by itself in row order."""
    dim = max((len(v) for _, v, _ in rows if v is not None), default=0)
    rows = [(i, v, lab) for i, v, lab in rows if i is not None and lab is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    x = [[max(-H.CLAMP, min(H.CLAMP, math.floor(256 * a))) for a in v] + [0] * (dim - len(v)) for _, v, _ in rows]
    out = []
    for a, (ai, _, al) in enumerate(rows):
        if not anchor(ai):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x[a], x[b])), rows[b][0], b) for b in range(len(rows)) if b != a)
        pos = [s for s in scored if rows[s[2]][2] == al][:n_pos]
        for ps, pi, _ in pos:
            neg = [s for s in scored if rows[s[2]][2] != al and low * -ps <= 100 * -s[0] <= 100 * -ps][:n_neg]
            out += [(ai, pi, k + 1, s[1], -ps, -s[0]) for k, s in enumerate(neg)]
    return sorted(out)


def mined(spark, rows, anchor, **more):
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], SCHEMA)
    return sorted(tuple(r) for r in H.hard_negatives(df, anchor, F.col("label"), **more).collect())


@pytest.mark.parametrize("dim", [1, 3, 20])
def test_against_brute_force(spark, dim, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 30)          # several blocks of rows and of anchors
    monkeypatch.setattr(H, "ANCHORS", 7)
    rnd = random.Random(dim)
    centre = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = [(i, [c + rnd.gauss(0, 0.4) for c in centre[i % 4]], rnd.randrange(3)) for i in range(160)]
    got = mined(spark, rows, F.col("vec_id") % 9 == 0)
    assert got == brute(rows, lambda i: i % 9 == 0) and got


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 1), (2, [0.9, 0.5], 1), (3, [1.0, 0.4], 2), (4, [1.0, 0.4], 3),
            (5, [1.0], 2), (6, [], 2), (7, None, 2), (8, [1.0, None], 2), (9, [nan, 1.0], 2), (10, [inf, 1.0], 2), (11, [1.0, 0.5], None),
            (None, [1.0, 0.5], 2), (100, [-1.0, -1.0], 2), (200, [0.0, 0.0], 1), (300, [1e9, 2.0], 4), (400, [1.0, 1.0], 9), (0, [1.0, 0.5], 1),
            (12, [1e300, -1e300], 3)]
    assert mined(spark, rows, F.col("vec_id") % 100 == 0) == brute(rows, lambda i: i % 100 == 0)
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], SCHEMA)
    assert H.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    assert H.hard_negatives(df, F.lit(None).cast("boolean"), F.col("label")).count() == 0


def test_bounds_hold_and_tighten():
    rnd = np.random.default_rng(5)
    v = rnd.integers(-300, 300, (200, 64)) + np.repeat(rnd.integers(-200, 200, (200, 16)), 4, axis=1)
    mean, dev = H.summary(v)
    import pyarrow as pa
    raw = {c: pa.array([r.tobytes() for r in m], pa.binary()) for c, m in (("vec", v.astype("<i4")), ("mean", mean), ("dev", dev))}
    block = H.Block(pa.table({"row": np.arange(200), "id": np.arange(200), "label": np.zeros(200, np.int64)} | raw))
    width = []
    for level in range(len(block.levels)):
        low, high = block.bounds(level, np.arange(200), mean[0], dev[0])
        assert (low <= v @ v[0]).all() and (v @ v[0] <= high).all()
        width.append((high - low).mean())
    assert width[0] > width[1] > width[2] > 0
