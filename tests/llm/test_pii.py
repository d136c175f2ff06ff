import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm import brute
from veloscope.llm.pii import KINDS, find_pii, op2_pii

SCHEMA = "doc_id long, text string, kind string, score int"


def check(rows, got):
    got = sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    for (i, text), r in zip(sorted(rows, key=lambda x: (x[0] is None, x[0])), got, strict=True):
        base = brute.pii(text)
        assert r["doc_id"] == i
        assert [(s["name"], s["start"], s["end"]) for s in r["base"]] == base, text
        for k in brute.PII:
            assert r[f"n_{k}"] == sum(b[0] == k for b in base)
        assert {(s["name"], s["start"], s["end"]) for s in r["spans"]} >= set(base)


def test_random_texts(spark):
    rng = random.Random(5)
    parts = ["a", "@", ".", "b-c", "+", "1", "23", "4539578763621486", " ", "-", "(", ")", "255", "256", "_", "%", "é",
             "😀", "x@y.z", "1.2.3.4", "+49 30 1234567", "\n", "  ", "GB82 WEST 1234 5698 7654 32"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(500)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    check(rows, find_pii(df).collect())


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.co"), (4, "a" * 60_000), (5, "1" * 60_000), (6, "1." * 30_000),
            (7, "+1" + " " * 60_000), (8, "a@b" + ".c" * 30_000), (9, "x@y.z," * 3000), (10, "a.b@c.d_e@f.g")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    check(rows, find_pii(df).collect())
    assert find_pii(df.limit(0)).count() == 0
    twice = find_pii(df.unionByName(df)).collect()
    assert len(twice) == 2 * len(rows)


def test_added_kinds(spark):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32."), (2, "GB83 WEST 1234 5698 7654 32"), (3, "my ssn is 123-45-6789"),
            (4, "build 123-45-6789"), (5, "call me: 555-123-4567"), (6, "555-123-4567"), (7, "phone +1 (974) 555-3436")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [s["name"] for s in r["spans"]] for r in find_pii(df).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: ["tel"], 6: [], 7: ["phone"]}


def test_query(spark):
    got = op2_pii(spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: brute.pii(r["text"]) for r in docs}
    assert len(got) == len(docs)
    for r in got:
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(text)
    assert sum(len(v) for v in want.values()) > 5


@pytest.mark.parametrize("kind", [k.name for k in KINDS])
def test_native(spark, kind):
    d = find_pii(spark.createDataFrame([(1, "x")], "doc_id long, text string").where(F.lit(kind) != ""))
    assert "Python" not in d._jdf.queryExecution().toString()
