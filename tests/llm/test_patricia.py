import random

import pytest

import veloscope.llm.patricia as P
from tests.conftest import SF_SMALL
from tests.llm.brute import sha

SCHEMA = "doc_id long, text string, rep string, ord int"


def want(rows, keep):
    """Per row (id, keep_id, size, sha), and per group one kept row with the kept id."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    pick = min if keep == "smallest" else max
    best = {t: pick((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), sha(t or "")) for i, t in rows), key=str), best


def check(got, rows, keep):
    every, best = want(rows, keep)
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["sha"]) for r in got), key=str) == every
    kept = [(r["sha"], r["id"]) for r in got if r["kept"]]
    assert sorted(kept) == sorted((sha(t), i) for t, i in best.items())


def test_query_against_plain_grouping(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [r.asDict() | {"id": r["doc_id"], "sha": r["text_sha256"]} for r in P.op13_exact_dedup(spark, SF_SMALL).collect()]
    check(got, rows, "largest")
    assert any(r["group_size"] > 1 for r in got)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_defined_cases(spark, keep):
    rows = [(5, None), (4, ""), (3, "a"), (9, "a"), (9, "a"), (7, "ab"), (-2, "abc"), (None, "abc"), (None, "only null"),
            (None, "only null"), (1, "é" * 50_000), (2, "é" * 50_000), (6, "é" * 49_999 + "x"), (8, "A"), (0, "a ")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = P.owners(df, keep=keep).collect()
    ties = [r for r in got if r["id"] == 9]
    assert len(ties) == 2 and (sum(r["kept"] for r in ties) == (1 if keep == "largest" else 0))
    nulls = [r for r in got if r["sha"] == sha("only null")]
    assert [r["keep_id"] for r in nulls] == [None, None] and sum(r["kept"] for r in nulls) == 1
    check(got, rows, keep)
    assert P.owners(df.limit(0)).count() == 0


def test_spilled_subtrees_and_hot_text(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))) + "z" * rnd.choice([0, 300]) for _ in range(400)]
    rows = [(i, rnd.choice(texts) if i % 3 else "the hot text " * 40) for i in range(3000)]
    rows[7] = (7, "long " * 20_000)                     # beyond the limit of a trie by itself
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    check(P.owners(df, chunk_bytes=30_000, trie_bytes=8_000).collect(), rows, "smallest")


def test_a_trie_spills_and_keeps_the_rest():
    trie, texts = P.Trie(), [bytes([97 + i % 5]) * (1 + i % 40) + b"x" * (i % 7) for i in range(600)]
    for i, t in enumerate(texts):
        assert trie.insert(t, 1, P.order_key(i, i), [i])
    held = {o[0]: (o[1], o[2][1], sorted(o[3])) for o in trie.terminals(trie.root)}
    assert held == {t: (texts.count(t), texts.index(t), [i for i, x in enumerate(texts) if x == t]) for t in set(texts)}
    limit = trie.bytes // 2
    out = {o[0] for o in trie.spill(limit)}
    left = {o[0] for o in trie.terminals(trie.root)}
    assert out and left and not out & left and out | left == set(texts)
    assert trie.bytes == sum(len(t) + P.NODE_BYTES for t in left) <= limit // 2
    assert all(trie.insert(t, 1, (False, 0, 0), [0]) == (t in left) for t in set(texts))


def test_rows_shuffled_for_a_hot_text_follow_the_chunks():
    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({"ord": list(range(a, a + 5000)), "row": list(range(a, a + 5000)), "text": [b"same"] * 5000})
               for a in (0, 5000)]
    out = list(P.chunks(batches, 2 << 20))
    assert len(out) == 1 and out[0].column("text").null_count == 9999
