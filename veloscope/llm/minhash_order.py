"""Order MinHash fingerprints: likeness that follows edit distance, not only shared content.

A text is its words (words longer than ``PIECE`` bytes are cut into pieces, so text without blanks has
tokens too). Its k-mers are runs of ``k`` tokens, each numbered by its occurrence so far in the text.
Each of ``m`` hash functions orders the numbered k-mers; the ``l`` smallest are taken, put back
into text order, and the tuple of their contents is hashed to one coordinate. Two texts agree in a
coordinate if the same k-mers are chosen in the same order; the likeness is the share of
coordinates that agree.

``edited_neighbours`` pairs each document with the next by id without any ordering in one task: range
partitions by id, each streamed in order; only the last row of a partition waits for the first row of
the next non-empty one (the very last for the very first).

Defined cases: a null text is the empty text; texts without tokens share one fingerprint; texts of
fewer than k tokens are one k-mer, with fewer than l k-mers the tuple is shorter; order of documents is
by (id, text) with null ids first, so ties and repeated rows have a fixed order; a table of one row
is its own next; extra columns are ignored; an empty table gives no rows. Long texts are processed
in blocks of ``BLOCK`` k-mers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veloscope.llm.common import text_or_empty, written

PIECE, BLOCK = 16, 1 << 15
MEMO = 1 << 18          # remembered token hashes per task
K, L, M = 2, 2, 64
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class TokenHashes(dict):
    def __missing__(self, token: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def multipliers(m: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"order {i}") | 1 for i in range(m)], np.uint64)


def tokens(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").split()
    if words and max(map(len, words)) > PIECE:
        words = [w[i:i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def kmers(text: str, k: int, memo: TokenHashes) -> np.ndarray:
    words = tokens(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mix(out + h[i:len(h) - k + 1 + i] + _C)
    return out


def occurrence(h: np.ndarray) -> np.ndarray:
    """How many equal values stand before each value."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))
    return out


def smallest(values: np.ndarray, a: np.ndarray, l: int) -> np.ndarray:
    """(m, <= l) positions of the l smallest ``values * a_j`` per function, over blocks."""
    best = np.empty((len(a), 0), np.int64)
    for at in range(0, len(values), BLOCK):
        pos = np.arange(at, min(at + BLOCK, len(values)))
        p = values[pos][None, :] * a[:, None]
        rows, take = np.arange(len(a)), []
        for _ in range(min(l, len(pos))):
            i = p.argmin(1)
            take.append(pos[i])
            p[rows, i] = np.uint64(2**64 - 1)
        best = np.concatenate([best, np.stack(take, 1)], 1)
        if best.shape[1] > l:
            keep = np.argsort(values[best] * a[:, None], 1, kind="stable")[:, :l]
            best = np.take_along_axis(best, keep, 1)
    return best


def signature(text: str, k: int, l: int, a: np.ndarray, memo: TokenHashes) -> np.ndarray:
    """m 16-bit coordinates."""
    h = kmers(text, k, memo)
    if not len(h):
        return np.zeros(len(a), np.uint16)
    numbered = mix(h ^ mix(occurrence(h).astype(np.uint64) * _C))
    at = np.sort(smallest(numbered, a, l), 1)               # back into text order
    out = a.copy()
    for i in range(at.shape[1]):
        out = mix(out * _B + h[at[:, i]])
    return (out >> np.uint64(48)).astype(np.uint16)


def hexed(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


RESULT = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


class Maker:
    """Results of (id, text, next text), remembering the signature of the text seen last."""

    def __init__(self, k: int, l: int, m: int):
        self.k, self.l, self.a, self.memo = k, l, multipliers(m), TokenHashes()
        self.last: tuple = (None, None)

    def of(self, text: str) -> np.ndarray:
        if self.last[0] != text:
            self.last = (text, signature(text, self.k, self.l, self.a, self.memo))
        return self.last[1]

    def row(self, key, text: str, following: str) -> tuple:
        own, changed = self.of(text), edited(text, following)
        new = own if changed == text else signature(changed, self.k, self.l, self.a, self.memo)
        nxt = self.of(following)
        return (key, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), hexed(own), hexed(new),
                float((own == new).mean()), float((own == nxt).mean()))


def batches_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


BASE = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
#: a finished row; or an edge of partition ``part`` with its text: 1 first row (finished elsewhere), 2 last row (waits)
STREAMED = BASE.append(pa.field("part", pa.int32())).append(pa.field("edge", pa.int32())).append(pa.field("text", pa.string()))


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, l: int = L,
                      m: int = M) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and two likenesses (``RESULT``)."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    d = d.repartitionByRange(n, "id").sortWithinPartitions("id", "text")

    def run(batches):
        make, part, held, first = Maker(k, l, m), TaskContext.get().partitionId(), None, True
        for b in batches:
            rows = []
            for key, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                if first:
                    rows.append((key,) + (None,) * 6 + (part, 1, text))
                    first = False
                else:
                    rows.append(make.row(*held, text) + (part, 0, None))
                held = (key, text)
            if rows:
                yield batches_of(rows, STREAMED)
        if held is not None:
            yield batches_of([(held[0],) + (None,) * 6 + (part, 2, held[1])], STREAMED)

    s = written(d.mapInArrow(run, RESULT + ", part int, edge int, text string"), "neighbours")
    # which non-empty partition follows: one row per partition, without texts
    firsts = s.where("edge = 1").select("part", F.col("text").alias("following"))
    parts = firsts.select("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")),
                                            F.min("part").over(Window.partitionBy())).alias("next"))
    waiting = s.where("edge = 2").select("id", "text", "part").join(after, "part") \
        .join(firsts.withColumnRenamed("part", "next"), "next").select("id", "text", "following")

    def finish(batches):
        make = Maker(k, l, m)
        for b in batches:
            rows = [make.row(*x) for x in zip(*(b.column(c).to_pylist() for c in ("id", "text", "following")))]
            if rows:
                yield batches_of(rows, BASE)

    names = BASE.names
    return s.where("edge = 0").select(*names).unionByName(waiting.mapInArrow(finish, RESULT).select(*names))


def op10_order_minhash(spark, sf_dir: str) -> DataFrame:
    from veloscope.llm.common import documents
    return edited_neighbours(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
