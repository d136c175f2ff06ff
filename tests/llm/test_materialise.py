import hashlib

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from veloscope.llm import materialise as M


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        f = M.Feistel(n)
        s = f.slot(np.arange(n))
        assert sorted(s.tolist()) == list(range(n))
        assert f.sequence(s).tolist() == list(range(n))
    a, b = M.Feistel(1000).slot(np.arange(1000)), M.Feistel(1000, 7).slot(np.arange(1000))
    assert (a == b).sum() < 20 and (np.diff(a) == 1).sum() < 20


def stream(rows):
    enc, eot = M.tokenizer(M.VOCABULARY)
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    return [x for _, t in rows for x in [*enc.encode_ordinary(t), eot]], eot, rows


def check(rows, got, length, per_shard):
    ids, eot, _ = stream(rows)
    n = -(-len(ids) // length)
    f = M.Feistel(max(1, n))
    assert sorted(r["slot"] for r in got) == list(range(n))
    for r in got:
        seq = int(f.sequence(np.array([r["slot"]]))[0])
        part = ids[seq * length:(seq + 1) * length]
        assert r["seq"] == seq and r["n_tokens"] == len(part)
        assert np.frombuffer(bytes(r["tokens"]), "<u2").tolist() == part + [eot] * (length - len(part))
        assert r["shard"] == r["slot"] // per_shard and r["shard_offset"] == r["slot"] % per_shard * 2 * length
        assert r["doc_starts"][0] == 0 and len(r["doc_ids"]) == len(r["doc_starts"])


def test_round_trip_and_edges(spark):
    rows = [(3, None), (1, ""), (2, "<|endoftext|> is text"), (None, "no id"), (5, "é漢😀 " * 300), (5, "é漢😀 " * 300), (9, "a" * 5000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, slot int, tokens string")
    for length, per in ((7, 3), (64, 2), (100_000, 4)):
        check(rows, M.records(df, length, per).collect(), length, per)
    assert M.records(df.limit(0)).count() == 0
    enc, _ = M.tokenizer(M.VOCABULARY)
    ids, eot, ordered = stream(rows)
    texts, last = [], 0
    for at in [i for i, x in enumerate(ids) if x == eot]:
        texts.append(enc.decode(ids[last:at]))
        last = at + 1
    assert texts == [t for _, t in ordered]


def test_partitioning_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    a = {r["slot"]: bytes(r["tokens"]) for r in M.records(docs, 512, 16).collect()}
    b = {r["slot"]: bytes(r["tokens"]) for r in M.records(docs.repartition(13), 512, 16).collect()}
    assert a == b
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], M.records(docs, 512, 16).collect(), 512, 16)


def test_shards_resume(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    recs = M.records(docs, 128, 10)
    want = {r["slot"]: np.frombuffer(bytes(r["tokens"]), "<u2").tolist() for r in recs.collect()}
    path = tmp_path.as_uri() + "/shards"
    index = M.write_shards(recs, path)
    manifest = M.manifest(index).collect()
    assert sum(r["n_sequences"] for r in manifest) == len(want)
    assert sorted(r["first_slot"] for r in manifest) == list(range(0, len(want), 10))
    for r in manifest:
        data = open(r["file"], "rb").read()
        assert len(data) == r["n_bytes"] == r["n_sequences"] * 256 and hashlib.sha256(data).hexdigest() == r["sha256"]
    for first, n in ((0, len(want)), (7, 25), (len(want) - 3, 3)):
        got = [x.tolist() for x in M.read_slots(path, first, n, 128, 10)]
        assert got == [want[s] for s in range(first, first + n)]
    some = index.where("slot % 4 < 2")
    back = {r["slot"]: np.frombuffer(bytes(r["tokens"]), "<u2").tolist() for r in M.read_shards(some, path, 128).collect()}
    assert back == {s: t for s, t in want.items() if s % 4 < 2}


def test_shards_of_nothing_and_cut_short(spark, tmp_path):
    import pytest
    docs = spark.createDataFrame([(i, "some words " * 40) for i in range(9)], "doc_id long, text string")
    none = tmp_path.as_uri() + "/none"
    assert M.read_shards(M.write_shards(M.records(docs.limit(0), 16, 4), none), none, 16).count() == 0
    path = tmp_path.as_uri() + "/cut"
    index = M.write_shards(M.records(docs, 16, 4), path)
    assert M.read_shards(index, path, 16).count() == index.count() > 8
    last = tmp_path / "cut" / "shard-00000001.bin"
    last.write_bytes(last.read_bytes()[:-2])
    with pytest.raises(Exception, match="ends before slot"):
        M.read_shards(index, path, 16).collect()


def test_wide_vocabulary_is_refused(tmp_path):
    import base64

    import pytest
    f = tmp_path / "wide.tiktoken"
    f.write_bytes(b"".join(base64.b64encode(i.to_bytes(3, "big")) + b" %d\n" % i for i in range(65_537)))
    with pytest.raises(ValueError, match="16 bits"):
        M.tokenizer(str(f))


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, M.op7_training_order(spark, SF_SMALL).collect(), M.LENGTH, M.PER_SHARD)


def test_pieces_are_cut_and_packed_once(spark, tmp_path):
    """Dealing pieces to the partition of their shard needs no sample of them: each batch is cut by one task only."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), 9).alias("text"))
    recs = M.records(docs, length=16, per_shard=64)
    plan = recs._jdf.queryExecution().toString()
    assert "rangepartitioning(shard" not in plan
    rows = recs.select("shard", "slot", F.spark_partition_id().alias("part")).collect()
    assert len({r["shard"] for r in rows}) == 8 and len(rows) == len({r["slot"] for r in rows})
    ends = {p: [r["slot"] for r in rows if r["part"] == p] for p in sorted({r["part"] for r in rows})}
    joined = [s for p in sorted(ends) for s in ends[p]]
    assert joined == sorted(joined) and all(len({r["part"] for r in rows if r["shard"] == s}) == 1 for s in {r["shard"] for r in rows})


def test_split_pattern_gives_the_pieces_of_its_plain_form(spark):
    import random

    import tiktoken
    plain = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    assert "++" in M.PATTERN            # runs are not given back
    fast, _ = M.tokenizer(M.VOCABULARY)
    slow = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=fast._mergeable_ranks, special_tokens={})
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "\t\r\n", "\u00a0", "\u3000", "'s", "'ll", "'x", "'", "a", "Word", "\u00e9\u6f22", "12", "\u0663", "...", "$", "\U0001f600", "\x00", "\u2028"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(30))) for _ in range(20_000)]
    texts += [r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    for t in texts:
        assert fast.encode(t, disallowed_special=()) == slow.encode(t, disallowed_special=()), repr(t)
