import random
from collections import defaultdict

from tests.conftest import SF_SMALL
from tests.llm.brute import sha
from veloscope.llm import suffix_dedup as S


def brute(rows, depth):
    where = defaultdict(int)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for s in range(len(t) - depth + 1):
            where[t[s:s + depth]] += 1
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - depth + 1):
            if where[t[s:s + depth]] > 1:
                gone[s:s + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, sha(kept)))
    return sorted(out, key=str)


def result(df, name="doc_id"):
    return sorted(((r[name], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, tk string, p int")


def test_random_overlaps(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    pieces = [word(rng.randint(20, 90)) for _ in range(12)]
    rows = [(i, "".join(rng.choice([rng.choice(pieces), word(rng.randint(1, 60))]) for _ in range(rng.randint(0, 9))))
            for i in range(120)]
    rows += [(200, None), (201, ""), (202, "a" * 500), (203, "ab" * 300), (None, rows[5][1]), (204, pieces[0]), (204, pieces[0]),
             (205, "xyz" * 11 + "q"), (206, "漢字" * 40)]
    assert result(S.remove_repeats(frame(spark, rows), depth=40, digit=13)) == brute(rows, 40)


def test_one_passage_in_many_documents(spark):
    """Overlaps of every length with a hot passage, and variants of it: rows of a pass stay a few per place."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    hot, rows = word(90), []
    for i in range(260):
        a, z = (0, 90) if i % 2 else (rng.randint(0, 50), rng.randint(51, 90))
        p = hot[a:z]
        if i % 5 == 0:
            k = rng.randrange(len(p))
            p = p[:k] + "#" + p[k + 1:]
        rows.append((i, word(rng.randint(0, 60)) + p + word(rng.randint(0, 60))))
    made = []
    plain = S.written
    S.written = lambda d, name: made.append((name, plain(d, name))) or made[-1][1]
    try:
        assert result(S.remove_repeats(frame(spark, rows), depth=40, digit=13)) == brute(rows, 40)
    finally:
        S.written = plain
    passes = [d.count() for name, d in made if name == "digits"]
    assert 3 <= len(passes) <= 5 and max(passes) <= 8 * passes[0]


def test_blocks_of_long_texts():
    rng = random.Random(4)
    t = bytes(rng.choice(b"abc ") for _ in range(900))
    texts = [t, b"zz" + t[100:700], b"short", t[:39], t[:40]]
    roller = S.Roller(2000)
    want = None
    for limit in (100, 256, 1 << 12):
        seen = set()
        for row, p, before, after, kh, buf, a, z in S.runs(texts, 40, 13, roller, limit):
            for r, q, lo, hi, x, y in zip(row, p, before, after, a, z):
                assert buf[x:y + 40] == texts[r][q - lo:q - hi + 40]
                seen |= {(int(r), int(q), int(s)) for s in range(q - lo, q - hi + 1)}
        assert want is None or seen == want         # each window elects the same place, however texts are cut
        want = seen
    assert sorted((r, s) for r, _, s in want) == [(r, s) for r, x in enumerate(texts) for s in range(len(x) - 39)]


def test_empty(spark):
    assert S.remove_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = result(S.op4_suffix_dedup(spark, SF_SMALL))
    assert got == brute(rows, S.DEPTH) and sum(r[2] for r in got) > 0
