"""Quality classifier: a sparse rule ensemble over text statistics.

``statistics`` turns each whole text into a few dozen numbers with Spark SQL expressions. ``fit``
grows shallow forest trees on a bounded sample of labelled rows, takes every path from a root to
an inner node or leaf as a conjunctive rule (bounds merged per statistic), and fits logistic weights with
an L1 penalty on the rules' 0/1 columns, so few rules keep a weight. ``score`` compiles the kept rules
into one Spark column expression; scoring runs no model code.

Inputs of a score are statistics of the text alone. Training rows: labelled (non-null quality), not held
out, at most ``sample`` (by crc32 of the id; the bound keeps the fit small, the scores cover all rows).

Defined cases: a null text is the empty text; texts without words have all ratios 0; repeated rows each get
a result row; a document with several labels takes the smallest (bad wins); without labels of both
classes the score is the share of label 1 (0.5 without any); extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloscope.llm.common import crc_mod, text_or_empty, written

SAMPLE = 20_000     # labelled rows that a fit reads at most
THRESHOLD = 0.7     # predicted 1 at this score or above
HOLD_MOD, HOLD_REST = 4, 2

# character classes that one translate() maps to a single letter each
CLASSES = {"A": "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ", "0": "0123456789",
           "#": "#$%&*+/<=>@\\^_`{|}~§¶•", ".": ".,;:", "!": "!?", "(": "()[]\"'«»“”‘’"}


def _share(n: Column, of: Column) -> Column:
    return F.coalesce(n / F.when(of > 0, of), F.lit(0.0)).cast("double")


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """id and the statistics named in ``NAMES`` (doubles, never null), one row per input row."""
    d = df.select(F.col(id_col).alias("_id"), *keep, text_or_empty(text_col).alias("_t"))
    mapped = F.translate("_t", "".join(CLASSES.values()), "".join(k * len(v) for k, v in CLASSES.items()))
    d = d.withColumn("_c", mapped).withColumn(
        "_w", F.filter(F.split(F.col("_t"), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).withColumn(
        "_l", F.filter(F.split(F.col("_t"), "\n"), lambda x: x != ""))
    n, words, lines = F.length("_t"), F.size("_w"), F.size("_l")
    of = lambda c: n - F.length(F.replace(F.col("_c"), F.lit(c), F.lit("")))
    blank = n - F.length(F.translate("_t", " \n\t\r\x0b\x0c", ""))
    nxt = lambda i: F.get(F.col("_w"), i - 1)
    letter_end = F.col("_w")
    stats = {
        "log_chars": F.log1p(n), "log_words": F.log1p(words), "word_len": _share(n - blank, words),
        "upper": _share(of("A"), n), "digit": _share(of("0"), n), "symbol": _share(of("#"), n),
        "point": _share(of("."), n), "shout": _share(of("!"), n), "bracket": _share(of("("), n),
        "blank": _share(blank, n), "distinct_words": _share(F.size(F.array_distinct("_w")), words),
        "repeat_before": _share(F.size(F.filter("_w", lambda x, i: x == nxt(i))), words),
        "short_words": _share(F.size(F.filter("_w", lambda x: F.length(x) <= 3)), words),
        "long_words": _share(F.size(F.filter(letter_end, lambda x: F.length(x) > 14)), words),
        "bare_symbols": _share(F.size(F.filter("_w", lambda x: F.length(x) == 1)), words),
        "symbol_ends": _share(F.size(F.filter("_w", lambda x: F.right(x, F.lit(1)).isin(*"!#$%&*|"))), words),
        "line_words": _share(words, lines), "distinct_lines": _share(F.size(F.array_distinct("_l")), lines),
        "log_lines": F.log1p(lines),
    }
    return d.select("_id", *keep, *[c.cast("double").alias(k) for k, c in stats.items()]).withColumnRenamed("_id", id_col)


NAMES = ("log_chars", "log_words", "word_len", "upper", "digit", "symbol", "point", "shout", "bracket", "blank",
         "distinct_words", "repeat_before", "short_words", "long_words", "bare_symbols", "symbol_ends", "line_words",
         "distinct_lines", "log_lines")


@dataclass(frozen=True)
class Rule:
    """A conjunction of half-open bounds ``low < statistic <= high`` per statistic."""
    bounds: tuple       # ((name, low or None, high or None), ...)

    def column(self) -> Column:
        c = F.lit(True)
        for name, low, high in self.bounds:
            c = c & (F.col(name) > low if low is not None else F.lit(True)) \
                  & (F.col(name) <= high if high is not None else F.lit(True))
        return c


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: tuple      # ((Rule, weight), ...), non-zero weights only

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for rule, w in self.weights:
            z = z + F.when(rule.column(), w).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


LINE = re.compile(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def paths(debug: str) -> list[Rule]:
    """The rules of a tree from its printed form: one per prefix of a path, longest bounds merged."""
    found, stack = [], []
    for line in debug.splitlines():
        m = LINE.match(line)
        if not m:
            continue
        depth = len(m[1])
        stack = [s for s in stack if s[0] < depth] + [(depth, int(m[3]), m[4], float(m[5]))]
        box: dict = {}
        for _, f, op, x in stack:
            low, high = box.get(f, (None, None))
            box[f] = (low, x if high is None else min(high, x)) if op == "<=" else (x if low is None else max(low, x), high)
        found.append(Rule(tuple((NAMES[f], *box[f]) for f in sorted(box))))
    return found


def fit(train: DataFrame, label: str = "quality", trees: int = 24, depth: int = 3, l1: float = 0.002,
        seed: int = 11) -> Model:
    """``train``: the statistics and the 0/1 label of a bounded number of rows."""
    share = train.agg(F.avg(F.col(label).cast("double")).alias("p"), F.min(label).alias("a"), F.max(label).alias("b")).first()
    if share["p"] is None or share["a"] == share["b"]:
        p = min(max(0.5 if share["p"] is None else share["p"], 1e-6), 1 - 1e-6)
        return Model(math.log(p / (1 - p)), ())
    x = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(
        train.select(*NAMES, F.col(label).cast("double").alias("label"))).select("features", "label", *NAMES)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird",
                                    minInstancesPerNode=5).fit(x)
    rules = list(dict.fromkeys(r for t in forest.trees for r in paths(t.toDebugString)))
    if not rules:
        return Model(math.log(share["p"] / (1 - share["p"])), ())
    cols = [f"r{i}" for i in range(len(rules))]
    marked = x.select("label", *[r.column().cast("double").alias(c) for r, c in zip(rules, cols)])
    marked = VectorAssembler(inputCols=cols, outputCol="features").transform(marked).select("features", "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=l1, maxIter=60, standardization=True).fit(
        written(marked, "rules"))
    return Model(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients) if w != 0.0))


def training_rows(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled statistics rows outside the held-out part."""
    lab = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()) \
        .where(crc_mod(F.col("doc_id"), HOLD_MOD) != HOLD_REST) \
        .groupBy(F.col("doc_id").alias(id_col)).agg(F.min("quality").alias("quality"))
    rows = stats.select(id_col, *NAMES).join(lab, id_col)
    # a fixed order that says nothing about the text; top-n with n bounded
    return rows.orderBy(F.xxhash64(F.col(id_col)), *NAMES).limit(sample)


def classify(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Adds ``score`` to a table of statistics, learning from ``labels``."""
    model = fit(written(training_rows(stats, labels, id_col, sample), "training"))
    return stats.withColumn("score", model.score())


def op5_quality(spark, sf_dir: str) -> DataFrame:
    from veloscope.llm.common import documents, table
    stats = written(statistics(documents(spark, sf_dir)), "statistics")
    d = classify(stats, table(spark, sf_dir, "labels"))
    return d.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), HOLD_MOD) == HOLD_REST, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
