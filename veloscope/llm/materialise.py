"""Training-order materialisation: token sequences in a keyed global order, in fixed-stride shards.

Documents in id order form one stream of token ids (each document ends with ``eot``), cut into sequences of
``length`` tokens. A keyed Feistel network over the next even power of two, walked until it lands below the
number of sequences, gives each sequence its slot: a permutation that needs no table, has an
inverse, and is the same for every partitioning. Slots are dealt by range to shards of ``per_shard`` sequences;
a record is ``length`` little-endian 16-bit ids (the last one filled up with ``eot``), so record i of
a shard begins at byte i * stride and a reader can resume from any slot. Vocabularies of more than 65 536 ids, ``eot`` included, are refused.

Steps: range partitions by id tokenise their documents in order (written once, with each document's
start inside its partition); partition totals (a row per partition) give global starts; pieces go to the
range partition of their shard, compressed one by one, and are joined up a sequence at a time. ``write_shards`` puts each shard into one file
and gives an index of its records; ``read_shards`` reads records back by it, ``read_slots`` without Spark.

Defined cases: a null text is the empty text (one ``eot``); order is by (id, text), null ids first, repeated
rows follow each other; control strings of the vocabulary inside texts are ordinary text; an empty table gives
no sequence; extra columns are ignored. Tokenisers are read from ``vocabulary`` on each executor.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veloscope.llm.common import shared_folder, text_or_empty, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the published split pattern of this vocabulary, in its published form that does not backtrack (the same pieces)
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LENGTH, PER_SHARD, KEY = 2048, 2048, 20240229
ROUNDS = 6


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    import tiktoken
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if max(len(ranks), *ranks.values()) > 0xFFFF:
        raise ValueError(f"{vocabulary}: ids above 65535 do not fit into 16 bits")
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of range(n)."""
    n: int
    key: int = KEY

    @property
    def half(self) -> int:
        return max(1, ((self.n - 1).bit_length() + 1) // 2)

    def _round(self, r: int, x: np.ndarray) -> np.ndarray:
        k = np.uint64(xxhash.xxh64_intdigest(f"round {r}", self.key))
        x = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _walk(self, x, rounds) -> np.ndarray:
        x = np.array(x, np.uint64)          # a copy, at least 0-d
        h, low = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        todo = np.ones(x.shape, bool)
        while todo.any():
            a, b = x[todo] >> h, x[todo] & low
            for r in rounds:
                a, b = (b, a ^ self._round(r, b)) if rounds[0] == 0 else (b ^ self._round(r, a), a)
            x[todo] = (a << h) | b
            todo &= x >= np.uint64(self.n)
        return x.astype(np.int64)

    def slot(self, sequence) -> np.ndarray:
        return self._walk(sequence, range(ROUNDS))

    def sequence(self, slot) -> np.ndarray:
        return self._walk(slot, range(ROUNDS - 1, -1, -1))


TOKENS = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
PIECES = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("seq", pa.int64()), ("pos", pa.int32()), ("id", pa.int64()),
                    ("tokens", pa.binary())])
RECORDS = ("shard long, slot long, shard_offset long, seq long, n_tokens int, doc_ids array<long>, doc_starts array<int>, "
           "tokens binary")
RECORD = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("shard_offset", pa.int64()), ("seq", pa.int64()),
                    ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())),
                    ("tokens", pa.binary())])
SHARD_ROWS = 256        # records that one Arrow batch holds


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def token_stream(df: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """Tokens of each document in id order: (part, start in part, id, n, tokens), written once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")) \
        .repartitionByRange(n, "id").sortWithinPartitions("id", "text")

    def run(batches):
        enc, eot = tokenizer(vocabulary)
        part, start = TaskContext.get().partitionId(), 0
        end = np.array([eot], "<u2").tobytes()
        for b in batches:
            rows = []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                ids = enc.encode_to_numpy(text, disallowed_special=())
                rows.append((part, start, i, len(ids) + 1, ids.astype("<u2").tobytes() + end))
                start += len(ids) + 1
            if rows:
                yield batch(rows, TOKENS)

    return written(d.mapInArrow(run, "part int, start long, id long, n long, tokens binary"), "tokens", level=6)


def records(df: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, vocabulary: str = VOCABULARY,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence (``RECORDS``), dealt by range of shards and in slot order inside a partition."""
    spark = df.sparkSession
    t = token_stream(df, id_col, text_col, vocabulary)
    parts = t.groupBy("part").agg(F.sum("n").alias("total"))
    # a row per range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"), "total")
    total = parts.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    n_seq = -(-total // length)
    order = Feistel(max(1, n_seq), key)

    def cut(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
            first, last = at // length, (at + n - 1) // length
            row = np.repeat(np.arange(len(at)), last - first + 1)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
            slot = order.slot(seq)                          # one walk for the whole batch
            a, z = np.maximum(at[row], seq * length), np.minimum(at[row] + n[row], (seq + 1) * length)
            ids, tokens = b.column("id").to_pylist(), b.column("tokens").to_pylist()
            packed = zstandard.ZstdCompressor(level=5)
            cut_from, cut_to = (2 * (a - at[row])).tolist(), (2 * (z - at[row])).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array(slot // per_shard), pa.array(slot), pa.array(seq), pa.array((a - seq * length).astype(np.int32)),
                pa.array([ids[r] for r in row.tolist()], pa.int64()),
                pa.array([packed.compress(tokens[r][x:y]) for r, x, y in zip(row.tolist(), cut_from, cut_to)], pa.binary())],
                schema=PIECES)

    pieces = t.join(F.broadcast(offsets.select("part", "before")), "part") \
        .select((F.col("before") + F.col("start")).alias("at"), "id", "n", "tokens") \
        .mapInArrow(cut, "shard long, slot long, seq long, pos int, id long, tokens binary")
    n_shards = max(1, -(-n_seq // per_shard))
    n = min(n_shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # shards are equally large and their number is known: bounds need no sample, which would cut and pack all pieces once more
    pieces = pieces.repartitionById(n, F.floor(F.col("shard") * n / n_shards).cast("int")).sortWithinPartitions("shard", "slot", "pos")
    _, eot = tokenizer(vocabulary)
    fill = np.array([eot], "<u2").tobytes()

    def join_up(batches):
        unpacked = zstandard.ZstdDecompressor()
        rows, open_ = [], None              # open_: (shard, slot, seq, ids, starts, pieces, n)

        def close(o):
            shard, slot, seq, ids, starts, parts, n = o
            return (shard, slot, (slot - shard * per_shard) * 2 * length, seq, n, ids, starts,
                    b"".join(parts) + fill * (length - n))

        for b in batches:
            for shard, slot, seq, pos, i, piece in zip(*(c.to_pylist() for c in b.columns)):
                tokens = unpacked.decompress(piece)
                if open_ is None or open_[1] != slot:
                    if open_ is not None:
                        rows.append(close(open_))
                    open_ = (shard, slot, seq, [], [], [], 0)
                s, sl, sq, ids, starts, parts, n = open_
                ids.append(i)
                starts.append(pos)
                parts.append(tokens)
                open_ = (s, sl, sq, ids, starts, parts, n + len(tokens) // 2)
                if len(rows) >= SHARD_ROWS:
                    yield batch(rows, RECORD)
                    rows = []
        if open_ is not None:
            rows.append(close(open_))
        if rows:
            yield batch(rows, RECORD)

    return pieces.mapInArrow(join_up, RECORDS)


INDEX = pa.schema([*[RECORD.field(c) for c in RECORD.names if c != "tokens"], ("file", pa.string()), ("first_slot", pa.int64()),
                   ("n_sequences", pa.int64()), ("n_bytes", pa.int64()), ("shard_tokens", pa.int64()), ("sha256", pa.string())])
INDEX_DDL = RECORDS.replace(", tokens binary", "") + (", file string, first_slot long, n_sequences long, n_bytes long, "
                                                      "shard_tokens long, sha256 string")
READ_BYTES = 4 << 20    # of consecutive records that one read fetches


def write_shards(recs: DataFrame, path: str) -> DataFrame:
    """Write ``recs`` (as ``records`` gives them) as ``path``/shard-N.bin; returns the index: ``RECORDS`` without tokens, where the
    last record of a shard also names its file, size and digest (``manifest``).

    ``path``: a folder that all executors share, as a URI that pyarrow opens (file, s3, gs, hdfs). A shard is
    written under an attempt's name and then moved, so a repeated task replaces it by the same bytes.
    """
    names = [c for c in RECORD.names if c != "tokens"]

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        sink = held = None                  # held: the record before this one, out at the next
        first = n_seq = n_bytes = n_tokens = 0
        digest = hashlib.sha256()

        def close():
            sink.close()
            name = f"{base}/shard-{held[0]:08d}.bin"
            fs.move(f"{name}.{attempt}", name)
            return (*held, name, first, n_seq, n_bytes, n_tokens, digest.hexdigest())

        for b in batches:
            rows = []
            for row in zip(*(b.column(c).to_pylist() for c in [*names, "tokens"])):
                shard, tokens = row[0], row[-1]
                if held is None or held[0] != shard:
                    if held is not None:
                        rows.append(close())
                    sink = fs.open_output_stream(f"{base}/shard-{shard:08d}.bin.{attempt}")
                    first, n_seq, n_bytes, n_tokens, digest = row[1], 0, 0, 0, hashlib.sha256()
                else:
                    rows.append((*held, None, None, None, None, None, None))
                sink.write(tokens)
                digest.update(tokens)
                held, n_seq, n_bytes, n_tokens = row[:-1], n_seq + 1, n_bytes + len(tokens), n_tokens + row[4]
            if rows:
                yield batch(rows, INDEX)
        if held is not None:
            yield batch([close()], INDEX)

    return written(recs.mapInArrow(run, INDEX_DDL), "shard-index")


def manifest(index: DataFrame) -> DataFrame:
    """A row per shard: its file, slots, bytes, tokens and digest."""
    return index.where("file is not null").select("shard", "file", "first_slot", "n_sequences", "n_bytes",
                                                  F.col("shard_tokens").alias("n_tokens"), "sha256")


def read_shards(index: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """``RECORDS`` of the index rows, their tokens read from the shard files; consecutive slots in one read of bounded size."""
    names, stride = [c for c in RECORD.names if c != "tokens"], 2 * length

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(path)
        per_read = max(1, READ_BYTES // stride)
        for b in batches:
            shard, slot, at = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "slot", "shard_offset"))
            jump = np.flatnonzero((np.diff(slot) != 1) | (np.diff(shard) != 0)) + 1
            for run_from, run_to in zip([0, *jump.tolist()], [*jump.tolist(), len(slot)]):
                for lo in range(run_from, run_to, per_read):
                    hi = min(lo + per_read, run_to)
                    with fs.open_input_file(f"{base}/shard-{shard[lo]:08d}.bin") as f:
                        data = f.read_at((hi - lo) * stride, int(at[lo]))
                    if len(data) != (hi - lo) * stride:
                        raise EOFError(f"shard {shard[lo]} ends before slot {slot[hi - 1]}")
                    tokens = pa.array([data[i:i + stride] for i in range(0, len(data), stride)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in names], tokens], schema=RECORD)

    return index.select(*names).mapInArrow(run, RECORDS)


def read_slots(path: str, first: int, n: int, length: int = LENGTH, per_shard: int = PER_SHARD):
    """The token ids of slots first .. first + n - 1, by seeking: a reader that resumes."""
    fs, base = pafs.FileSystem.from_uri(path)
    stride = 2 * length
    while n > 0:
        shard, at = divmod(first, per_shard)
        take = min(n, per_shard - at)
        with fs.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            data = f.read_at(take * stride, at * stride)
        yield from np.frombuffer(data, "<u2").reshape(-1, length)
        if len(data) < take * stride:
            return
        first, n = first + take, n - take


def op7_training_order(spark, sf_dir: str) -> DataFrame:
    """The records as the shard files hold them, read back in ranges of slots."""
    from veloscope.llm.common import documents
    path = shared_folder(spark, "shards")
    return read_shards(write_shards(records(documents(spark, sf_dir)), path), path)
