import random

import numpy as np

from tests.conftest import SF_SMALL
from tests.llm.brute import sha
from veloscope.llm import minhash_order as O


def check(rows, got):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    got = sorted(got, key=lambda r: (r["id"] is not None, r["id"] or 0))
    want = []
    for n, (i, t) in enumerate(rows):
        e = O.edited(t, rows[(n + 1) % len(rows)][1])
        want.append((i, len(t), sha(e)))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((r["id"], r["n_chars"], r["edited_sha256"]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 4 * O.M


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = O.op10_order_minhash(spark, SF_SMALL).withColumnRenamed("doc_id", "id").collect()
    check(rows, got)
    fp = {}
    text = dict(rows)
    for r in got:
        assert fp.setdefault(text[r["id"]], r["fingerprint"]) == r["fingerprint"]
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > 0.3 > 0.1 > mean("near_next")


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "a b c"), (5, "wörd " * 20_000), (6, "漢" * 5000), (None, "z"),
            (9, "😀😀😀😀")]
    df = spark.createDataFrame([(i, t, "f", 0.1) for i, t in rows], "doc_id long, text string, fingerprint string, id double")
    check(rows, O.edited_neighbours(df).collect())
    assert O.edited_neighbours(df.limit(0)).count() == 0
    one = spark.createDataFrame([(4, "abcd efgh")], "doc_id long, text string")
    check([(4, "abcd efgh")], O.edited_neighbours(one).collect())


def brute_signature(text, a):
    """The definition, one k-mer at a time."""
    memo = O.TokenHashes()
    h = O.kmers(text, O.K, memo)
    seen, numbered = {}, []
    for x in h.tolist():
        n = seen[x] = seen.get(x, -1) + 1
        numbered.append(O.mix(np.uint64(x) ^ O.mix(np.array([n], np.uint64) * O._C))[0])
    out = []
    for c in a:
        order = sorted(range(len(h)), key=lambda i: int(numbered[i] * c) if True else 0)[:O.L]
        t = np.array([c])
        for i in sorted(order):
            t = O.mix(t * O._B + h[i])
        out.append(int(t[0] >> np.uint64(48)))
    return out


def test_signature_against_definition(monkeypatch):
    rng = random.Random(2)
    a = O.multipliers(8)
    np.seterr(over="ignore")
    for block in (O.BLOCK, 7):
        monkeypatch.setattr(O, "BLOCK", block)
        for n in (1, 2, 3, 10, 60):
            t = " ".join(rng.choice("abcde") for _ in range(n))
            assert O.signature(t, O.K, O.L, a, O.TokenHashes()).tolist() == brute_signature(t, a)


def test_order_matters():
    a, memo = O.multipliers(O.M), O.TokenHashes()
    left, right = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    one = O.signature(" ".join(left + right), O.K, O.L, a, memo)
    two = O.signature(" ".join(right + left), O.K, O.L, a, memo)        # same k-mers but one, other order
    edit = O.signature(" ".join(left[:30] + ["new"] + left[31:] + right), O.K, O.L, a, memo)
    assert (one == edit).mean() > (one == two).mean() + 0.2
