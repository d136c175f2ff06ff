"""n-gram language model scoring with Elias-Fano tries.

The corpus is cut into chunks of documents (about ``CHUNK`` bytes of text, written once, compressed). Each chunk
asks for the corpus counts of its distinct n-grams of every order and adds its own training counts: one compressed
Elias-Fano list per chunk, order and shard of the n-gram hash space. A shard sums up the counts of all chunks and
answers each chunk in the order it asked, so an answer carries no keys. n-grams are dealt by hash of the whole
n-gram, already counted within their chunk: a word or word pair in a third of all rows costs its shard one entry per
chunk.

A chunk is scored against its part of the model: a trie whose levels hold, for the n-grams of the chunk that the
training text has, successor ids made monotone within their context's range (Elias-Fano), pointers from each
node to its successors (Elias-Fano), and log probabilities and back-off weights in 16 bits. The levels lie in a
memory-mapped scratch file. A token is looked up by a successor search inside its context's range.

Model: interpolated relative frequencies. P(w | ctx) = (1 - s) c(ctx w) / c(ctx) + s P(w | shorter ctx), with
s = a_k c(ctx)^-b_k (``BACKOFF``; s = 1 for an unseen context); contexts do not cross the start of a text. The
words of the vocabulary share 1 - u by frequency, the one class of unknown words has u = (words seen
once) / (training tokens). Word hashes have 64 bits; hashes of longer n-grams have log2(tokens) + ``margin``, which keeps the chance of
a false match of a look-up near 2^-margin at any size.

Defined cases: a null text is the empty text (one end token); a null id belongs to the training side by
the checksum of the empty text; repeated rows are counted and scored each; an empty table gives no rows; without
training tokens every token is unknown with probability 1 (score 0); extra columns are ignored. A chunk holds at
least one text, so a very long text is a chunk of its own.
"""

from __future__ import annotations

import math
import mmap
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloscope.llm.common import LOWER, UPPER, crc_mod, text_or_empty, written
from veloscope.llm.elias_fano import EliasFano
from veloscope.llm.suffix_dedup import Roller

ORDER, CHUNK = 3, 6 << 20
HASH_BLOCK = 1 << 20
MARGIN = 17             # bits of an n-gram hash beyond log2(tokens)
#: (a, b) of the share that a context of count c leaves to the shorter context, by order
BACKOFF = {2: (0.8, 0.12), 3: (0.5, 0.10), 4: (0.4, 0.10), 5: (0.4, 0.10)}
HOLD_MOD, HOLD_REST = 7, 2
STEPS = 4096            # quantisation steps per unit of log10
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_END = np.uint64(0x5EED5EED5EED5EED)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

CHUNKS = "chunk long, ids array<long>, held array<boolean>, sizes array<long>, data binary"
_CHUNKS = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                     ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
ASKS = "shard int, ord int, chunk long, n long, keys binary, counts binary"
_ASKS = pa.schema([("shard", pa.int32()), ("ord", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()),
                   ("counts", pa.binary())])
ANSWERS = "chunk long, ord int, shard int, counts binary, tokens long, words long, once long"
_ANSWERS = pa.schema([("chunk", pa.int64()), ("ord", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary()),
                      ("tokens", pa.int64()), ("words", pa.int64()), ("once", pa.int64())])
SCORES = ("id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
_SCORES = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def chunks(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Documents packed into chunks; ``sizes`` are the texts' bytes inside the decompressed ``data``."""
    d = df.select(F.col(id_col).cast("long").alias("id"),
                  (crc_mod(F.col(id_col), HOLD_MOD) == HOLD_REST).alias("held"), text_or_empty(text_col).alias("text"))

    def run(batches):
        part, seq, rows, parts, n = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            return batch([((part << 24) | seq, [r[0] for r in rows], [r[1] for r in rows], [len(p) for p in parts],
                           zstandard.compress(b"\n".join([*parts, b""]), 3))], _CHUNKS)

        for b in batches:
            for i, held, text in zip(*(b.column(c).to_pylist() for c in ("id", "held", "text"))):
                t = text.encode("utf-8", "surrogatepass").translate(_LOWER)
                if rows and n + len(t) > size:
                    yield close()
                    seq, rows, parts, n = seq + 1, [], [], 0
                rows.append((i, held))
                parts.append(t)
                n += len(t)
        if rows:
            yield close()

    return written(d.mapInArrow(run, CHUNKS), "chunks")


@lru_cache(maxsize=1)
def roller(size: int) -> Roller:
    return Roller(size)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word of ``data``: prefix sums of byte codes times powers, block by block."""
    b = np.frombuffer(data, np.uint8)
    blank = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    first, end = edge[::2], edge[1::2]
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):
        upto = max(int(np.searchsorted(end, first[at] + HASH_BLOCK)), at + 1)       # whole words, one at least
        lo, hi = int(first[at]), int(end[upto - 1])
        r = roller(max(HASH_BLOCK, 1 << (hi - lo).bit_length()))
        c = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(r.code[b[lo:hi]] * r.up[:hi - lo], out=c[1:])
        f = first[at:upto] - lo
        out[at:upto] = (c[end[at:upto] - lo] - c[f]) * r.down[f]
        at = upto
    out = (out ^ (out >> np.uint64(32))) * _A
    out = (out ^ (out >> np.uint64(29))) * _B
    return first, out ^ (out >> np.uint64(32))


class Tokens:
    """The token stream of a chunk: hashes, document numbers, places in the document, training flags.

    Texts lie in ``data`` one after another, each followed by a blank.
    """

    def __init__(self, held: list, sizes: list, data: bytes):
        first, words = word_hashes(zstandard.decompress(data))
        doc = np.searchsorted(np.cumsum(np.array(sizes) + 1), first, "right")
        counts = np.bincount(doc, minlength=len(sizes)) + 1
        ends = np.cumsum(counts)
        self.h = np.full(int(ends[-1]), _END, np.uint64)
        self.h[np.arange(len(words)) + doc] = words
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
        self.place = np.arange(len(self.h), dtype=np.int32) - np.repeat((ends - counts).astype(np.int32), counts)
        self.train = ~np.repeat(np.array(held, bool), counts)

    def keys(self, order: int, bits: int):
        """(order, key per n-gram, index of its last token) for each order, n-grams inside one document."""
        full = self.h
        for k in range(1, order + 1):
            at = np.flatnonzero(self.place >= k - 1)
            if k > 1:
                nxt = np.zeros_like(full)
                x = (full[at - 1] * _A + self.h[at]) * _B
                x = (x ^ (x >> np.uint64(32))) * _A
                nxt[at] = x ^ (x >> np.uint64(29))
                full = nxt
            yield k, (full if k == 1 else full[at] >> np.uint64(64 - bits)), at


def bits_of(k: int, bits: int) -> int:
    return 64 if k == 1 else bits


def heads(s: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    return np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, np.int64)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the index of one occurrence each."""
    order = np.argsort(key)
    s = key[order]
    first = heads(s)
    return s[first], order[first]


def counted(key: np.ndarray, train: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs in training texts."""
    if bits < 64:                                   # the flag travels in the low bit of what is sorted
        s = np.sort((key << np.uint64(1)) | train)
        flag, s = (s & np.uint64(1)).astype(np.int64), s >> np.uint64(1)
    else:
        order = np.argsort(key)
        s, flag = key[order], train[order].astype(np.int64)
    first = heads(s)
    return s[first], np.add.reduceat(flag, first) if len(first) else np.empty(0, np.int64)


def ask(order: int, bits: int, shard_bits: int):
    def run(batches):
        for b in batches:
            for chunk, held, sizes, data in zip(*(b.column(c).to_pylist() for c in ("chunk", "held", "sizes", "data"))):
                t = Tokens(held, sizes, data)
                for k, key, at in t.keys(order, bits):
                    uniq, count = counted(key, t.train[at], bits_of(k, bits))
                    width = bits_of(k, bits) - shard_bits
                    edge = np.searchsorted(uniq >> np.uint64(width), np.arange((1 << shard_bits) + 1).astype(np.uint64))
                    rows = []
                    for s in np.flatnonzero(np.diff(edge)).tolist():
                        a, z = int(edge[s]), int(edge[s + 1])
                        ef = EliasFano.of(uniq[a:z] - np.uint64(s << width), 1 << width)
                        rows.append((s, k, chunk, z - a, ef.to_bytes(), zstandard.compress(count[a:z].astype("<u4").tobytes())))
                    if rows:
                        yield batch(rows, _ASKS)

    return run


def answer(table: pa.Table) -> pa.Table:
    """All lists of one (shard, order): corpus totals, back to each chunk in its own order."""
    shard, order = table.column("shard")[0].as_py(), table.column("ord")[0].as_py()
    chunk = table.column("chunk").to_pylist()
    keys = [EliasFano.from_buffer(x).decode() for x in table.column("keys").to_pylist()]
    counts = [np.frombuffer(zstandard.decompress(x), "<u4") for x in table.column("counts").to_pylist()]
    uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(uniq)).astype(np.int64)
    rows, at = [], 0
    for c, k in zip(chunk, keys):
        mine = total[inverse[at:at + len(k)]]
        at += len(k)
        rows.append((c, order, shard, zstandard.compress(mine.astype("<u8").tobytes()), None, None, None))
    rows.append((-1, order, shard, None, int(total.sum()), int((total > 0).sum()), int((total == 1).sum())))
    return pa.Table.from_batches([batch(rows, _ANSWERS)])


def quantised(logp: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logp * STEPS), 0, 65535).astype("<u2")


def share_left(k: int, c: np.ndarray) -> np.ndarray:
    """The share of probability that a context of count c leaves to the shorter one."""
    a, b = BACKOFF[k]
    return np.where(c > 0, a * np.maximum(c, 1).astype(float) ** -b, 1.0)


def mapped(parts: dict[str, bytes]) -> dict[str, tuple]:
    """The parts in one memory-mapped scratch file: name -> (buffer, offset, length)."""
    file = tempfile.TemporaryFile()                # has no name: nothing stays when the task ends
    at, where = 0, {}
    for name, data in parts.items():
        file.write(data + bytes(-len(data) % 8))
        where[name] = (at, len(data))
        at += len(data) + -len(data) % 8
    file.write(bytes(8))
    file.flush()
    buf = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    file.close()
    return {k: (buf, *v) for k, v in where.items()}


def codes(part: tuple) -> np.ndarray:
    buf, at, n = part
    return np.frombuffer(buf, "<u2", n // 2, at) if n else np.zeros(0, np.uint16)


class Level:
    """A trie level: successor ids (Elias-Fano over parent * words + word), probability codes, and, once the level below is
    known, pointers to the successors (Elias-Fano) and back-off codes."""

    def __init__(self, keys: np.ndarray, universe: int, logp: np.ndarray, count: np.ndarray):
        m = mapped({"ids": EliasFano.of(keys, universe).to_bytes(), "prob": quantised(logp).tobytes()})
        self.ids, self.prob, self.count = EliasFano.from_buffer(*m["ids"][:2]), codes(m["prob"]), count

    def link(self, parents: np.ndarray, left: np.ndarray) -> None:
        """``parents``: the node of this level above each node of the next one, in order."""
        pointers = np.searchsorted(parents, np.arange(len(self.count) + 1)).astype(np.uint64)
        m = mapped({"ptr": EliasFano.of(pointers, len(parents) + 1).to_bytes(), "bow": quantised(np.log10(left)).tobytes()})
        self.pointers, self.bow = EliasFano.from_buffer(*m["ptr"][:2]), codes(m["bow"])

    def successors(self, below: Level, parent: np.ndarray, word: np.ndarray, n_words: int) -> np.ndarray:
        """Node of ``word`` among the successors of each parent node, or -1."""
        p = self.pointers.decode().astype(np.int32)
        return below.ids.find(parent.astype(np.uint64) * np.uint64(n_words) + word.astype(np.uint64), p[parent], p[parent + 1])


def log_probabilities(t: Tokens, counts: dict, order: int, bits: int, n_train: int, once: int) -> tuple[np.ndarray, np.ndarray]:
    """(count of each token's word, log10 probability of each token) under the model.

    The trie grows a level at a time: the nodes above a new level, and the shorter contexts' probabilities in it,
    are looked up in the levels built so far.
    """
    unknown = min(max(once, 1) / n_train, 0.5) if n_train else 1.0
    up = word = node = logp = None                  # node, logp: of each token's n-gram so far
    n_words = 0
    for k, key, at in t.keys(order, bits):
        if k == 1:
            uniq, _ = distinct(key)
            n_words, c = len(uniq), counts[1]
            p1 = np.log10(np.where(c > 0, (1 - unknown) * c / max(n_train, 1), unknown))
            up = Level(uniq, 1 << 64, p1, c)
            word = node = up.ids.find(t.h).astype(np.int32)
            logp = -up.prob[word].astype(np.float32) / STEPS
            continue
        _, where = distinct(key)
        del key
        end, c = at[where], counts[k]               # a token where each distinct n-gram ends
        parent = node[end - 1]
        seen = (c > 0) & (parent >= 0)
        end, parent, c = end[seen], parent[seen], c[seen]
        sort = np.lexsort((word[end], parent))
        end, parent, c = end[sort], parent[sort], c[sort]
        left = share_left(k, up.count)
        lower = 10.0 ** logp[end].astype(float)     # P(w | shorter context) at that token
        p = np.log10(np.minimum((1 - left[parent]) * c / up.count[parent] + left[parent] * lower, 1.0))
        here = Level(parent.astype(np.uint64) * np.uint64(n_words) + word[end].astype(np.uint64),
                     max(1, len(up.count)) * n_words + 1, p, c)
        up.link(parent, left)
        del where, seen, sort, end, lower, p
        ctx = node[at - 1]
        at, ctx = at[ctx >= 0], ctx[ctx >= 0]
        found = up.successors(here, ctx, word[at], n_words)
        back = logp[at] - up.bow[ctx].astype(np.float32) / STEPS
        hit = found >= 0
        back[hit] = -here.prob[found[hit]].astype(np.float32) / STEPS
        logp[at] = back
        node = np.full(len(t.h), -1, np.int32)
        node[at] = found
        up = here
    return counts[1][word], logp


def score_chunk(order: int, bits: int, n_train: int, n_words: int, once: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for ids, held, sizes, data in zip(*(left.column(c).to_pylist() for c in ("ids", "held", "sizes", "data"))):
            t = Tokens(held, sizes, data)
            got: dict = {k: [] for k in range(1, order + 1)}
            for k, s, x in zip(*(right.column(c).to_pylist() for c in ("ord", "shard", "counts"))):
                got[k].append((s, x))
            counts = {k: np.concatenate([np.frombuffer(zstandard.decompress(x), "<u8") for _, x in sorted(v)]).astype(np.int64)
                      if v else np.empty(0, np.int64) for k, v in got.items()}
            c, logp = log_probabilities(t, counts, order, bits, n_train, once)
            n_docs = len(ids)
            base = np.log10((c + 1) / (n_train + n_words + 1))
            rows += zip(ids, held, np.bincount(t.doc, minlength=n_docs).tolist(), np.bincount(t.doc, c > 0, n_docs).astype(int).tolist(),
                        [n_train] * n_docs, np.bincount(t.doc, base, n_docs).tolist(), np.bincount(t.doc, logp, n_docs).tolist())
        return pa.Table.from_batches([batch(rows, _SCORES)]) if rows else _SCORES.empty_table()

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk: int = CHUNK,
          margin: int = MARGIN) -> DataFrame:
    """``SCORES``, one row per document."""
    packed = chunks(df, id_col, text_col, chunk)
    n_bytes = packed.agg(F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x + 1)), F.lit(0))
                         .alias("b")).first()["b"]
    bits = min(64, math.ceil(math.log2(max(n_bytes / 6, 2))) + margin)
    shard_bits = max(0, math.ceil(math.log2(max(n_bytes / (4 * chunk), 1))))
    asked = packed.select("chunk", "held", "sizes", "data").mapInArrow(ask(order, bits, shard_bits), ASKS)
    answers = written(asked.groupBy("shard", "ord").applyInArrow(answer, ANSWERS), "answers")
    total = answers.where("chunk = -1 and ord = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c)
                                                          for c in ("tokens", "words", "once")]).first()
    mine = answers.where("chunk >= 0").select("chunk", "ord", "shard", "counts")
    return packed.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(
        score_chunk(order, bits, total["tokens"], total["words"], total["once"]), SCORES)


def op1_ngram_lm(spark, sf_dir: str) -> DataFrame:
    from veloscope.llm.common import documents
    return score(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
