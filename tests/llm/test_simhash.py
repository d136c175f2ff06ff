import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import veloscope.llm.simhash as S
from tests.conftest import SF_SMALL
from tests.llm import brute

SCHEMA = "doc_id long, text string, fp string, id int"


def fingerprint(text, k=3):
    w = brute.words(text)
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(items, linked):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, x in enumerate(items):
        for y in items[:i]:
            if linked(x, y):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {x: find(x) for x in items}


def want(rows, radius=2):
    fp = [fingerprint(t) for _, t in rows]
    root = union(sorted(set(fp)), lambda a, b: (a ^ b).bit_count() <= radius)
    low = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            low[root[f]] = min(i, low.get(root[f], i))
    return sorted(((i, f, low.get(root[f])) for (i, _), f in zip(rows, fp)), key=str)


def result(df):
    return sorted(((r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in df.collect()), key=str)


def test_query_and_edge_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], int(r["fingerprint"], 16), r["component_id"])
                  for r in S.op8_simhash(spark, SF_SMALL).collect()), key=str)
    assert got == want(rows)
    assert len({c for *_, c in got}) < len(got)
    odd = [(5, None), (4, ""), (3, " \n"), (2, "One"), (1, "ONE"), (None, "one two"), (7, "one two"), (8, "one\ttwo\x0bthree"),
           (8, "one\ttwo\x0bthree"), (9, "é É"), (None, "lonely row"), (10, "a " * 40_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in odd], SCHEMA)
    assert result(S.simhash_components(df)) == want(odd)
    assert S.simhash_components(df.limit(0)).count() == 0


def groups(spark, fps, radius=2, **more):
    df = spark.createDataFrame([(S.signed(f),) for f in fps], "fp long")
    comp = {r["node"]: r["root"] for r in S.components(S.links(df, radius, **more)).collect()}
    got = {}
    for f in fps:
        got.setdefault(comp.get(S.signed(f), S.signed(f)), set()).add(f)
    return sorted(map(sorted, got.values()))


def planted(n, seed=1):
    rng = random.Random(seed)
    fps = {rng.getrandbits(64) for _ in range(n)}
    for f in list(fps):
        for _ in range(3):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    return sorted(fps)


def by_root(root):
    out = {}
    for x, r in root.items():
        out.setdefault(r, set()).add(x)
    return sorted(map(sorted, out.values()))


def test_links_are_complete(spark):
    fps = planted(120)
    assert groups(spark, fps) == by_root(union(fps, lambda a, b: (a ^ b).bit_count() <= 2))


def test_crowded_cells(spark):
    """Cells beyond the limit are re-keyed: same answer."""
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 5))) for _ in range(150)} | set(planted(20)))
    assert groups(spark, fps, crowded=8) == by_root(union(fps, lambda a, b: (a ^ b).bit_count() <= 2))


def test_pivot_filter_discards_only_unlinked():
    fps = np.array(planted(60), np.uint64)
    i, r = S.cell_links(np.zeros(len(fps), int), fps, 2)
    root = dict(zip(fps[i].tolist(), fps[r].tolist()))
    got = {int(f): root.get(int(f), int(f)) for f in fps}
    assert by_root(got) == by_root(union(fps.tolist(), lambda a, b: (a ^ b).bit_count() <= 2))


def test_components_on_a_long_path(spark):
    e = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = S.components(e).collect()
    assert {r["root"] for r in got} == {0} and len(got) == 200


def kept_of(rows, radius=2):
    """The (id, text) that stay: of each component the smallest id, null ids last, then by text digest."""
    fp = {t: fingerprint(t) for t in {t or "" for _, t in rows}}
    root = union(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= radius)
    best = {}
    for i, t in rows:
        key, g = (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest()), root[fp[t or ""]]
        best[g] = min(best.get(g, (key, i, t or "")), (key, i, t or ""), key=lambda x: x[0])
    return sorted(((i, t) for _, i, t in best.values()), key=str)


def test_keep_one_of_each_group(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(30):
        base = [word() for _ in range(rng.randint(80, 300))]
        for v in range(rng.randint(1, 5)):
            w = list(base)
            if v:
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w).upper() if v == 2 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, " "), (5, rows[5][1]), (None, rows[5][1]), (903, "one two"), (904, "one two"), (905, "two one"),
             (None, "no id"), (None, "no id"), (906, "long " * 60_000), (906, "other text of this id"), (907, "LONG " * 60_000)]
    df = spark.createDataFrame([(i, t, "x", 1, 2, "k") for i, t in rows], "doc_id long, text string, f string, g int, _n int, _key string")
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str) == kept_of(rows)
    assert S.keep_one(df.limit(0)).count() == 0
