"""Hard-negative mining: segment summary filtering.

Every vector is cut into 1, 4 and 16 segments; per segment the mean and the (population) deviation of its components are
stored beside the vector. For segments of length L, the inner product of two vectors lies within the sum over segments of
L * (mean * mean' +- dev * dev') (Cauchy-Schwarz on the centred parts). A search works through the levels: bounds of the coarsest
level for all rows of a block, then, for rows that may still count, those of the next level, and integer inner products for
what is left. What the bounds may not rule out is scored, so results are exact.

1. positives: the ``n_positives`` best other rows of the anchor's label. A row goes when its upper bound lies below the
   smallest of that many best lower bounds.
2. negatives: for each positive, the ``n_negatives`` best rows of another label with
   low * positive <= 100 * score <= 100 * positive. A row goes when its bounds miss every such interval, or lie below that
   many rows that are certainly inside.

Rows and anchors are dealt out as (row block, anchor block) pairs: a task holds one block of each (``ROWS``, ``ANCHORS``), and gives
back a bounded number of rows per anchor, which are merged by a ranked window. Nothing is broadcast.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; shorter vectors
are filled up with zeros; components are clamped to +-2^27 after scaling (so that scores of up to 512 dimensions fit a long); rows are
told apart by row, not by id: repeated ids are rows of their own (ties by row number then), and a copy of an anchor may
be its positive; anchors without positives or negatives give no rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloscope.llm.common import table, written

LEVELS = (1, 4, 16)         # segments of a vector, from coarse to fine
ROWS, ANCHORS = 1 << 16, 1 << 14
SCALE, CLAMP = 256.0, 1 << 27
LOW = 80                    # percent of the positive's score that a hard negative reaches
NONE = np.iinfo(np.int64).min


def segments(dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: the first component and the length of each segment."""
    out = []
    for n in sorted({min(x, max(dim, 1)) for x in LEVELS}):
        edge = np.array([dim * i // n for i in range(n + 1)])
        out.append((edge[:-1], np.diff(edge)))
    return out


def summary(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels, a row per vector."""
    means, devs = [], []
    for start, size in segments(v.shape[1]):
        x = v.astype(np.float64)
        m = np.add.reduceat(x, start, axis=1) / size
        x -= np.repeat(m, size, axis=1)
        means.append(m)
        devs.append(np.sqrt(np.add.reduceat(x * x, start, axis=1) / size))
    return np.hstack(means), np.hstack(devs)


def prepared(df: DataFrame, id_col: str, vector_col: str, label: Column, is_anchor: Column, dim: int) -> DataFrame:
    """(row, id, label, anchor, vec, mean, dev) of the rows that take part; the arrays as bytes (int32, double, double)."""
    d = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                  F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & good)
    kept = ("row", "id", "label", "anchor")

    def run(batches):
        for b in batches:
            v = b.column("v")
            size = np.diff(v.offsets.to_numpy())
            whole = np.zeros((len(b), dim))
            whole[np.arange(dim)[None, :] < size[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
            whole = np.clip(np.floor(whole * SCALE), -CLAMP, CLAMP).astype("<i4")
            raw = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (whole, *summary(whole))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + raw, [*kept, "vec", "mean", "dev"])

    return d.mapInArrow(run, "row long, id long, label long, anchor boolean, vec binary, mean binary, dev binary")


def matrix(column, kind: str) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1) if data else np.empty((0, 0), kind)


class Block:
    """Rows of one block in id order, with their summaries."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("id", "ascending"), ("row", "ascending")])
        self.row, self.id, self.label = (t.column(c).to_numpy() for c in ("row", "id", "label"))
        self.vec = matrix(t.column("vec"), "<i4").astype(np.int64)
        self.mean, self.dev = matrix(t.column("mean"), "<f8"), matrix(t.column("dev"), "<f8")
        self.levels, at = [], 0
        for _, size in segments(self.vec.shape[1]):
            self.levels.append((slice(at, at + len(size)), size.astype(np.float64)))
            at += len(size)

    def bounds(self, level: int, some: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the rows' scores with a vector of these means and deviations."""
        cut, size = self.levels[level]
        m, d = self.mean[some, cut], self.dev[some, cut]
        middle, width = m @ (mean[cut] * size), d @ (dev[cut] * size)
        slack = 1e-9 * (np.abs(m) @ np.abs(mean[cut] * size) + width) + 1e-6        # rounding of the sums
        return middle - width - slack, middle + width + slack


def kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value, -inf if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best(block: Block, some: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions in ``some`` of the k highest scores; ties by the order of rows."""
    return np.lexsort((some, -score))[:k]


def positives_in(block: Block, some: np.ndarray, vec, mean, dev, k: int) -> tuple[np.ndarray, np.ndarray]:
    for level in range(len(block.levels)):
        if len(some) <= k:
            break
        low, high = block.bounds(level, some, mean, dev)
        some = some[high >= kth(low, k)]
    score = block.vec[some] @ vec
    at = best(block, some, score, k)
    return some[at], score[at]


def negatives_in(block: Block, some: np.ndarray, vec, mean, dev, wanted: np.ndarray, low_percent: int, k: int):
    """Per positive score in ``wanted``: the rows and scores of the k best inside its interval."""
    floor = -((-low_percent * wanted) // 100)           # smallest whole score that reaches the share
    for level in range(len(block.levels)):
        if not len(some):
            break
        low, high = block.bounds(level, some, mean, dev)
        keep = np.zeros(len(some), bool)
        for least, most in zip(floor, wanted):
            sure = low[(low >= least) & (high <= most)]
            keep |= (high >= max(least, kth(sure, k))) & (low <= most)
        some = some[keep]
    score = block.vec[some] @ vec
    for least, most in zip(floor, wanted):
        inside = np.flatnonzero((score >= least) & (score <= most))
        at = inside[best(block, some[inside], score[inside], k)]
        yield some[at], score[at]


FOUND = "a_row long, p_row long, row long, id long, score long"


def search(rows: DataFrame, anchors: DataFrame, n_blocks: int, one) -> DataFrame:
    """What ``one(block, anchor ...)`` yields, (p_row, positions, scores), for every anchor and block of rows."""
    n_anchors = anchors.count()
    halls = max(1, -(-n_anchors // ANCHORS))
    left = rows.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(n_blocks))).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(halls - 1))))
    # columns of other names: both sides come from one table, and a cogroup mixes up columns that they share
    right = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns]) \
        .withColumn("a_h", F.pmod(F.xxhash64("a_row"), F.lit(halls)).cast("int")) \
        .withColumn("a_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {c: [np.empty(0, np.int64)] for c in ("a_row", "p_row", "row", "id", "score")}
        if left.num_rows and right.num_rows:
            block = Block(left)
            vec, mean, dev = (matrix(right.column(f"a_{c}"), k) for c, k in (("vec", "<i4"), ("mean", "<f8"), ("dev", "<f8")))
            more = [right.column(f"a_{c}").to_pylist() for c in ("row", "label", "p_rows", "p_scores")]
            for i, (row, label, p_rows, p_scores) in enumerate(zip(*more)):
                for p_row, at, score in one(block, row, label, vec[i].astype(np.int64), mean[i], dev[i], p_rows, p_scores):
                    for c, x in zip(got, (np.full(len(at), row), np.full(len(at), p_row), block.row[at], block.id[at], score)):
                        got[c].append(x)
        return pa.table({c: pa.array(np.concatenate(x), pa.int64()) for c, x in got.items()})

    return left.groupBy("b", "h").cogroup(right.groupBy("a_b", "a_h")).applyInArrow(run, FOUND)


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   n_positives: int = 5, n_negatives: int = 5, low_percent: int = LOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` and ``label`` are columns of ``df``."""
    spark = df.sparkSession
    dim = df.select(F.max(F.size(vector_col))).first()[0] or 0
    rows = written(prepared(df, id_col, vector_col, label, is_anchor, max(dim, 1)), "summaries")
    n_blocks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("p_rows", "p_scores")]
    rows, anchors = rows.drop("anchor"), rows.where("anchor").drop("anchor")

    def positive(block, row, label, vec, mean, dev, *_):
        some = np.flatnonzero((block.label == label) & (block.row != row))
        yield row, *positives_in(block, some, vec, mean, dev, n_positives)

    def negative(block, row, label, vec, mean, dev, p_rows, p_scores):
        some = np.flatnonzero(block.label != label)
        found = negatives_in(block, some, vec, mean, dev, np.array(p_scores, np.int64), low_percent, n_negatives)
        for p_row, (at, score) in zip(p_rows, found):
            yield p_row, at, score

    order = [F.col("score").desc(), F.col("id"), F.col("row")]
    pos = search(rows, anchors.select("*", *none), n_blocks, positive)
    pos = pos.withColumn("n", F.row_number().over(Window.partitionBy("a_row").orderBy(*order))).where(F.col("n") <= n_positives)
    pos = written(pos.select("a_row", "row", "id", "score"), "positives")
    of = pos.groupBy(F.col("a_row").alias("row")).agg(F.collect_list(F.struct("row", "score")).alias("p"))      # n_positives at most
    asked = written(anchors.join(of, "row").select("*", F.col("p.row").alias("p_rows"), F.col("p.score").alias("p_scores")).drop("p"), "anchors")
    neg = search(rows, asked, n_blocks, negative)
    neg = neg.withColumn("rank", F.row_number().over(Window.partitionBy("a_row", "p_row").orderBy(*order))).where(F.col("rank") <= n_negatives)
    named = pos.select("a_row", F.col("row").alias("p_row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = asked.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id"))
    return neg.join(named, ["a_row", "p_row"]).join(names, "a_row").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    return hard_negatives(table(spark, sf_dir, "embeddings"), is_anchor=F.col("vec_id") % 100 == 0,
                          label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, r.label = a.label AS same,
         CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM v a, v r WHERE a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.positive_score,
       n.score AS negative_score
FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score
  AND n.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5
"""
