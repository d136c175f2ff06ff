"""SimHash near-duplicates: fingerprints, pivot distance tables, components.

``fingerprints`` hashes the word shingles of whole texts (XXH64, seed 42) and takes each bit's
majority. ``links`` finds all pairs of distinct fingerprints at Hamming distance <= ``radius``
(exact): with radius r the 64 bits are cut into r + 3 blocks; two linked fingerprints agree on
at least 3 of them, so each fingerprint goes to one cell per choice of 3 blocks. Inside a cell,
the distances of every member to 16 fixed reference fingerprints (the pivots) are computed once;
a pair whose largest coordinate difference exceeds the radius cannot be linked (triangle inequality)
and is discarded, and survivors are verified on the fingerprints. A cell gives back a spanning
forest of its links, never all pairs. A cell with more than ``crowded`` members gives its members back
instead; those are re-keyed by every choice of r free bits set to zero, where equal keys are linked
(exact too), by a window over the re-keyed rows.

Copies are collapsed to distinct fingerprints first, so a third of all rows in one group of
copies costs one row. Components: star contraction over written tables, no driver state.

Defined cases: a null text is the empty text; texts without words have fingerprint zero and are linked
like any other; texts of fewer words than a shingle hash the whole sequence; repeated rows each get a
result row; rows with a null id take part, their component is the smallest non-null id (null if the
component has none); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veloscope.llm.common import LOWER, UPPER, written

LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
SEED = 42
CELL = 4096         # members of a cell that are compared in one task; larger cells are re-keyed
N_PIVOTS = 16


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased text: bytes.split() cuts at 0x20 and 0x09-0x0D, as the contract does."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, repeats included (fewer words: the whole sequence)."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    end = start[k - 1:] + size[k - 1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start[:len(end)].tolist(), end.tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The 64 bits set in over half of the hashes, as an unsigned integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):      # bounded memory for very long texts
        part = np.ascontiguousarray(h[i:i + (1 << 16)].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((ones * 2 > len(h)).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer; one row per input row."""
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fp = [majority(shingle_hashes(words_of(t.as_py()), k)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(fp, np.uint64).view(np.int64))],
                                             ["id", "fp"])

    return d.mapInArrow(run, "id long, fp long")


def blocks(radius: int) -> list[int]:
    """radius + 3 bit masks that cut 64 bits into near-equal runs."""
    n = radius + 3
    edges = [64 * i // n for i in range(n + 1)]
    return [sum(1 << b for b in range(a, z)) for a, z in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member index of each node's component, for links (a, b) among n nodes."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(N_PIVOTS)], np.uint64)


def cell_links(cell: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member index, root index) inside equal runs of ``cell`` (sorted)."""
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)      # the pivot distance table
    left, right = [], []
    at, s = np.arange(n - 1), 1
    while len(at):
        at = at[cell[at] == cell[at + s]]
        near = np.abs(table[at] - table[at + s]).max(1, initial=0) <= radius         # triangle inequality
        i = at[near]
        i = i[np.bitwise_count(fp[i] ^ fp[i + s]) <= radius]                         # verification
        left.append(i)
        right.append(i + s)
        s += 1
        at = at[at + s < n]
    a, b = (np.concatenate(x) if x else np.empty(0, int) for x in (left, right))
    root = forest(n, a, b)
    i = np.flatnonzero(root != np.arange(n))
    return i, root[i]


def links(fps: DataFrame, radius: int = 2, crowded: int = CELL) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints in ``fps.fp`` at distance <= radius."""
    masks = [sum(c) for c in combinations(blocks(radius), 3)]
    cells = fps.select("fp").distinct().select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("c", "key"))
    n = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cells = cells.repartition(int(n), "c", "key").sortWithinPartitions("c", "key", "fp")

    def run(batches):
        """Whole cells in sorted order; the open cell is carried to the next batch."""
        c, key, fp = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        crowd = None                          # (c, key) of a cell that has been given back so far

        def out(a, b, big):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                               pa.array(big, pa.int32())], ["a", "b", "c"])

        def emit(c, key, fp):
            nonlocal crowd
            if not len(fp):
                return
            new = np.concatenate(([True], (c[1:] != c[:-1]) | (key[1:] != key[:-1])))
            cell = np.cumsum(new) - 1
            size = np.bincount(cell)
            big = size > crowded
            if crowd == (int(c[0]), int(key[0])):
                big[0] = True
            crowd = (int(c[-1]), int(key[-1])) if big[-1] else None
            back = big[cell]
            if back.any():
                yield out(fp[back], fp[back], c[back])
            keep = ~back & (size[cell] > 1)
            if keep.any():
                f = fp[keep]
                i, r = cell_links(cell[keep], f.view(np.uint64), radius)
                yield out(f[i], f[r], np.full(len(i), -1, np.int32))

        for b in batches:
            c = np.concatenate((c, b.column("c").to_numpy(zero_copy_only=False).astype(np.int32)))
            key = np.concatenate((key, b.column("key").to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, b.column("fp").to_numpy(zero_copy_only=False)))
            if not len(fp):
                continue
            last = int(np.flatnonzero((c != c[-1]) | (key != key[-1]))[-1]) + 1 \
                if ((c != c[-1]) | (key != key[-1])).any() else 0
            yield from emit(c[:last], key[:last], fp[:last])
            c, key, fp = c[last:], key[last:], fp[last:]
            if len(fp) > crowded:                # an open cell that is large already: give it back piecemeal
                yield out(fp, fp, c)
                crowd = (int(c[0]), int(key[0]))
                c, key, fp = c[:0], key[:0], fp[:0]
        yield from emit(c, key, fp)

    found = written(cells.mapInArrow(run, "a long, b long, c int"), "links")
    # crowded cells: all choices of `radius` free bits set to zero; equal rest = linked, so neighbours suffice
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    zeros = F.lit(None)
    for j, bits in enumerate(free):
        zeros = F.when(F.col("c") == j, F.array(*[F.lit(signed(~sum(1 << x for x in z) & (1 << 64) - 1))
                                                  for z in combinations(bits, radius)])).otherwise(zeros)
    crowd = found.where("c >= 0").select("c", F.col("a").alias("fp"))
    rekeyed = crowd.select("fp", "c", F.posexplode(zeros).alias("z", "mask")) \
        .select("fp", "c", "z", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"))
    chain = rekeyed.select("fp", F.lag("fp").over(Window.partitionBy("c", "z", "rest").orderBy("fp")).alias("b"))
    return found.where("c < 0").select("a", "b").unionByName(
        chain.where("b IS NOT NULL").select(F.col("fp").alias("a"), "b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges``: root is the smallest node of its component.

    Large-star / small-star contraction; each round is two aggregates and joins over a written table.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        # large star: every larger neighbour points to the smallest node around
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        new = big.join(low, "u")
        new = new.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(new, "edges")
        # a star forest: no node is both a leaf and a root
        if new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi").isEmpty() and \
                new.groupBy("u").count().where("count > 1").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        e = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                       radius: int = 2) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links, itself included."""
    fps = written(fingerprints(df, id_col, text_col, k), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("id").alias("low"))
    comp = components(links(fps, radius)).withColumnRenamed("node", "fp")
    # a fingerprint's component by its root fingerprint, the id by the smallest id of the root's members
    rooted = written(least.join(comp, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """``df`` (all columns) with one document of each component: the smallest id, null ids last, then by text digest.

    Rows equal in id and text are one document: one of them stays.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = df.select(F.struct(*df.columns).alias("_doc"), F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).cast("long").alias("id"),
                                                                     F.md5(text.cast("binary")).alias("digest")).alias("_key"), text.alias("_text"))

    def run(batches):
        for b in batches:
            fp = [majority(shingle_hashes(words_of(t), k)) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["_key", "fp"])

    fps = written(named.select("_key", "_text").mapInArrow(
        run, "_key struct<last:boolean,id:long,digest:string>, fp long").groupBy("_key", "fp").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    least = fps.groupBy("fp").agg(F.min(F.struct("_key", "n")).alias("best"))       # copies meet before anything is joined
    best = least.join(components(links(fps, radius)).withColumnRenamed("node", "fp"), "fp", "left") \
        .groupBy(F.coalesce("root", "fp").alias("group")).agg(F.min("best").alias("best"))
    kept = written(best.select(F.struct(F.col("best._key.last"), F.coalesce("best._key.id", F.lit(0)).alias("id"),
                                        F.col("best._key.digest")).alias("_key"), F.col("best.n").alias("_n")), "kept")
    key = F.struct(F.col("_key.last"), F.coalesce("_key.id", F.lit(0)).alias("id"), F.col("_key.digest"))
    d = named.select("_doc", key.alias("_key")).join(kept, "_key")
    return d.where("_n = 1").select("_doc.*").unionByName(d.where("_n > 1").dropDuplicates(["_key"]).select("_doc.*"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    from veloscope.llm.common import documents
    d = simhash_components(documents(spark, sf_dir))
    return d.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id")
