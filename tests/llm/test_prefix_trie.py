import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import veloscope.llm.prefix_trie as T
from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string, h1 string, depth int"


def crc6(c):
    return zlib.crc32(str(c).encode()) % 6


def brute(rows, shared=crc6, group=100):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    base = {c: c - (abs(c) % group) * (1 if c >= 0 else -1) for c in own}
    seq = {c: own.get(base[c], [])[:shared(c)] + own[c][shared(c):] for c in own}
    members = defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids, leaves, saved = (defaultdict(int) for _ in range(3))
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not kids.get(k)
    ends = {k: ",".join(map(str, sorted(c for c in m if len(seq[c]) == len(k)))) for k, m in members.items()}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k],
                    hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()), key=str)


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def built(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return T.prefix_trie(df, lambda c: F.crc32(c.cast("string").cast("binary")) % 6, 5, 100, **more)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(T.op12_prefix_trie(spark, SF_SMALL)) == brute(rows)


def test_defined_cases(spark):
    rows = [(0, 0, "user", "a"), (0, 1, None, "b"), (0, None, "system", None), (1, 0, "user", "own"), (2, 0, "user", "é" * 3000), (3, 5, None, None),
            (3, 5, None, None), (None, 0, "user", "nobody"), (101, 0, "user", "no base"), (102, 0, "u", "x"), (-3, 0, "user", "a"), (-3, 1, "u", "b"),
            (-250, 0, "user", "below"), (7, 0, "user,a", "b"), (8, 0, "user", ",ab")] + [(50 + i, 0, "user", "tail") for i in range(20)]
    assert nodes(built(spark, rows)) == brute(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert T.prefix_trie(df.limit(0)).count() == 0
    assert nodes(T.prefix_trie(df)) == brute(rows, lambda c: 0, 1)


@pytest.mark.parametrize("band,shard", [(3, 5), (7, 40)])
def test_units_and_shards_cut_anywhere(spark, monkeypatch, band, shard):
    monkeypatch.setattr(T, "BAND", max(band, 6) if band == 7 else 6)
    monkeypatch.setattr(T, "SHARD", shard)
    monkeypatch.setattr(T, "PIECE", 60)
    rnd, rows = random.Random(band), []
    for c in range(120):
        n = rnd.choice([1, 2, 5, 9, 30])
        kind = rnd.randrange(3)         # a hot conversation, a common first turn, random turns
        rows += [(c, i, "u", f"hot {i}" if kind == 0 else "first" if kind == 1 and i == 0 else f"{rnd.randrange(3)}") for i in range(n)]
    rows += [(500, i, "u", f"hot {i}") for i in range(70)]
    assert nodes(built(spark, rows)) == brute(rows)


def test_double_array_holds_exactly_its_paths():
    rnd = np.random.default_rng(1)
    paths = {tuple(rnd.integers(0, 30, rnd.integers(1, 6))) for _ in range(400)}
    prefixes = {p[:d] for p in paths for d in range(1, len(p) + 1)}
    trie, slot = T.DoubleArray(), {(): 0}
    for d in range(1, 6):
        new = sorted((slot[p[:-1]], int(p[-1]), p) for p in prefixes if len(p) == d)
        at = trie.place(np.array([x[0] for x in new]), np.array([x[1] for x in new]))
        slot |= {x[2]: int(s) for x, s in zip(new, at)}
    assert len(set(slot.values())) == len(slot)
    for _ in range(3000):
        p, state = tuple(rnd.integers(0, 30, rnd.integers(1, 6))), np.array([0])
        for c in p:
            state = trie.step(state, np.array([c])) if state[0] >= 0 else state
        assert state[0] == slot.get(p, -1)
