import math
import zlib
from collections import Counter

import numpy as np

from tests.conftest import SF_SMALL
from tests.llm import brute
from veloscope.llm import ngram_lm as N
from veloscope.llm.elias_fano import EliasFano


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (1, 1 << 60), (5, 1 << 20), (3000, 1 << 45), (3000, 4000), (500, 1 << 63), (2000, 50)):
        v = np.sort(rng.integers(0, u, n, dtype=np.uint64))
        e = EliasFano.from_buffer(EliasFano.of(v, u).to_bytes())
        assert e.decode().tolist() == v.tolist()
        i = np.arange(n)
        assert e.access(i).tolist() == v.tolist() if n else True
        probe = np.concatenate([v, rng.integers(0, u, 500, dtype=np.uint64)])
        got = e.find(probe)
        have = set(v.tolist())
        for p, g in zip(probe.tolist(), got.tolist()):
            assert (g >= 0) == (p in have) and (g < 0 or v[g] == p)


def share(k, c):
    a, b = N.BACKOFF[k]
    return a * c ** -b if c else 1.0


def brute_scores(rows, order):
    grams = [Counter() for _ in range(order + 1)]
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2:
            continue
        w = brute.words(t) + [" "]
        for k in range(1, order + 1):
            grams[k].update(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
    n, v = sum(grams[1].values()), len(grams[1])
    u = min(max(sum(c == 1 for c in grams[1].values()), 1) / n, 0.5) if n else 1.0

    def p(w, ctx):
        if not ctx:
            c = grams[1][w,]
            return (1 - u) * c / n if c else u
        c, s = grams[len(ctx)][ctx], share(len(ctx) + 1, grams[len(ctx)][ctx])
        return (1 - s) * (grams[len(ctx) + 1][(*ctx, w)] / c if c else 0) + s * p(w, ctx[1:])

    out = []
    for i, t in rows:
        w = brute.words(t) + [" "]
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(w), sum(grams[1][x,] > 0 for x in w), n,
                    sum(math.log10((grams[1][x,] + 1) / (n + v + 1)) for x in w),
                    sum(math.log10(p(x, tuple(w[max(0, j - order + 1):j]))) for j, x in enumerate(w))))
    return out, p, grams, u


def check(rows, got, order):
    want, *_ = brute_scores(rows, order)
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:5] == w[:5]
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        # a code is off by half a step at most; a token's probability passes through 2 * order - 1 codes
        assert abs(g[6] - w[6]) < w[2] * (2 * order - 1) / (2 * N.STEPS) + 1e-6, (g, w)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, N.score(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), margin=40).collect(), N.ORDER)
    got = N.op1_ngram_lm(spark, SF_SMALL).withColumnRenamed("doc_id", "id").collect()
    want = {r[0]: r for r in brute_scores(rows, N.ORDER)[0]}
    assert len(got) == len(rows)
    for r in got:           # with the production hash width a false match may touch a text
        w = want[r["id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[1:5] and abs(r["base_score"] - w[5]) < 1e-6
    assert sum(abs(r["score"] - want[r["id"]][6]) > 0.001 * r["n_tokens"] for r in got) <= 4
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges_and_chunks(spark):
    rows = [(1, None), (2, ""), (3, "A b a B a"), (3, "A b a B a"), (None, "a b"), (4, "unknown words é"), (5, "a " * 3000), (9, "b a b"),
            (12, "a b c d e f"), (13, "zz")]
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, id string")
    for order, chunk in ((1, 100), (2, 8), (3, 1 << 20), (4, 40)):
        check(rows, N.score(df, order=order, chunk=chunk, margin=40).collect(), order)
    assert N.score(df.limit(0)).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {(r["n_known"], r["score"]) for r in N.score(held).collect()} == {(0, 0.0)}


def test_probabilities_sum_to_one():
    rows = [(i, t) for i, t in enumerate(["a b a c", "b b a", "c a b d", "a b a b", "d"])]
    _, p, grams, _ = brute_scores(rows, 3)
    vocabulary = [w for (w,) in grams[1]]
    for ctx in ((), ("a",), ("a", "b"), ("b", "zz"), ("zz",)):
        assert abs(sum(p(w, ctx) for w in vocabulary) + p("unknown", ctx) - 1) < 1e-9
