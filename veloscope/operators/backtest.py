"""Walk-forward backtest with a model fitted in every window.

Features are point-in-time, so one table of them serves all windows: no row sees anything after itself. It is
written once, in folders of ``gcd(train, test, step)`` days, its numeric features as one vector, and every window reads its own folders only. What training needs to know
beforehand (rows and positives for the skip rules and class weights, the labels of the encoder) is kept per folder and added up:
a window's counts are differences of running totals. Fits start from a bounded pool of threads, and the scores of all windows
are stored and evaluated together, grouped by window.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate
from math import gcd

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators import evaluation as EV
from veloscope.operators import learn as L
from veloscope.operators import splits as SP
from veloscope.operators.features import feature_matrix
from veloscope.session import written_once

DAY_US = 86_400_000_000
TASK_ROWS = 20_000          # training rows of a task: an iteration's cost is its tasks where windows are small
MOST_TASK_ROWS = 200_000    # ... and where they are large, as other windows fill the cores
NUMERIC = "numeric"
SCORES = "window_id int, transaction_id long, is_fraud int, score double"


def logistic() -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="is_fraud", weightCol="weight", maxIter=20, regParam=0.01)


class StepState:
    """Additive training state per step: running totals of rows and positives, the encoder's labels."""

    def __init__(self, features: DataFrame):
        y = F.col("is_fraud")
        per = features.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
        values = features.where(y.isNotNull()).select("step", F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit(L.UNKNOWN)).alias("v")) for c in L.CATEGORICAL])).alias("x"))
        counts = {r["step"]: (r["n"], r["pos"], r["neg"]) for r in per.collect()}          # a row per step of the time line
        self.steps = max(counts, default=-1) + 1
        self.totals = [list(accumulate((counts.get(s, (0, 0, 0))[i] for s in range(self.steps)), initial=0)) for i in range(3)]
        self.values: dict[int, set] = {}
        for r in values.select("step", "x.c", "x.v").distinct().collect():                 # what the encoders hold anyway
            self.values.setdefault(r["step"], set()).add((r["c"], r["v"]))

    def counts(self, first: int, end: int) -> tuple[int, int, int]:
        """(rows, positives, negatives) of the steps first .. end - 1."""
        a, z = (min(max(s, 0), self.steps) for s in (first, end))
        return tuple(t[z] - t[a] for t in self.totals)

    def encoder(self, first: int, end: int) -> PipelineModel:
        """The codes of the values seen in these steps, alphabetical, and the feature vector; no job."""
        seen = set().union(*(self.values.get(s, set()) for s in range(first, end)))
        codes = [StringIndexerModel.from_labels(sorted(v for c, v in seen if c == name), inputCol=name, outputCol=f"{name}_idx", handleInvalid="keep")
                 for name in L.CATEGORICAL]
        names = [NUMERIC] + [f"{c}_idx" for c in L.CATEGORICAL]
        return PipelineModel(stages=[*codes, VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")])


def step_features(txn: DataFrame, days: int, ts: str = "timestamp") -> DataFrame:
    """Point-in-time features (id, label, categories, ``NUMERIC``) with their step, written in a folder per step of ``days``; undated
    rows are in no window. A row is in several windows and read twice by each fit, so its numeric features are assembled here."""
    first = txn.agg(F.min(ts).alias("_t0"))
    at = F.floor((F.unix_micros(F.col(ts)) - F.unix_micros("_t0")) / F.lit(days * DAY_US)).cast("int")
    x = feature_matrix(txn, mode="point_in_time").where(F.col(ts).isNotNull())
    x = x.crossJoin(F.broadcast(first)).withColumn("step", at).drop("_t0").fillna(L.UNKNOWN, [c for c in L.CATEGORICAL if c in x.columns])
    x = VectorAssembler(inputCols=L.numeric_features(), outputCol=NUMERIC, handleInvalid="keep").transform(x) \
        .select("transaction_id", "is_fraud", *L.CATEGORICAL, NUMERIC, "step")
    # few files a step, and several tasks for a step that holds most rows
    return written_once(x.hint("rebalance", F.col("step")), "step-features", partition_by=["step"])


def _tasks(n: int, cores: int) -> int:
    """The tasks of a pass over ``n`` training rows: small ones up to the number of cores, then large ones."""
    return max(1, min(-(-n // TASK_ROWS), cores), -(-n // MOST_TASK_ROWS))


def fit_windows(txn: DataFrame, out_dir: str, train_days: int, test_days: int, step_days: int, learner=logistic,
                ts: str = "timestamp", parallel: int = 8, **limits) -> DataFrame:
    """Scores of every window's test rows: (window_id, transaction_id, is_fraud, score), stored in ``out_dir``.

    A window is one row of ``splits.walk_forward_windows`` that its skip rules let pass; ``parallel`` bounds the fits at one time.
    """
    spark, width = txn.sparkSession, gcd(train_days, test_days, step_days)
    x = step_features(txn, width, ts)
    state = StepState(x)
    train, test, step = (d // width for d in (train_days, test_days, step_days))
    last = SP.walk_forward_windows(txn, ts, train_days, test_days, step_days).agg(F.max("window_id")).first()[0] or 0
    plan = []
    for i in range(last):
        a, cut = i * step, i * step + train
        (n, pos, _), (_, test_pos, _) = state.counts(a, cut), state.counts(cut, cut + test)
        if SP.skip_reason(n, pos, test_pos, **limits) is None:
            plan.append((i + 1, a, cut))

    def fit(window):
        number, a, cut = window
        n, pos, neg = state.counts(a, cut)
        enc, at = state.encoder(a, cut), F.col("step")
        # in an array the weight is data of the compiled plan, not part of its code: one compilation serves all windows
        weight = F.get(F.array(F.lit(1.0), F.lit(neg / pos if pos else 1.0)), F.coalesce((F.col("is_fraud") == 1).cast("int"), F.lit(0)))
        rows = x.where((at >= a) & (at < cut) & F.col("is_fraud").isNotNull()).withColumn("weight", weight)
        model = learner().fit(enc.transform(rows.coalesce(_tasks(n, spark.sparkContext.defaultParallelism))))
        out = model.transform(enc.transform(x.where((at >= cut) & (at < cut + test))))
        out.select("transaction_id", "is_fraud", L.p1().alias("score")).write.mode("overwrite").parquet(f"{out_dir}/window_id={number}")

    if not plan:
        return spark.createDataFrame([], SCORES)
    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(inheritable_thread_target(spark)(fit), plan))
    return spark.read.parquet(out_dir)


def backtest(txn: DataFrame, out_dir: str, train_days: int = K.BACKTEST_TRAIN_DAYS, test_days: int = K.BACKTEST_TEST_DAYS,
             step_days: int = K.BACKTEST_STEP_DAYS, **more) -> DataFrame:
    """The metric row of every fitted window."""
    scores = fit_windows(txn, out_dir, train_days, test_days, step_days, **more)
    return EV.evaluate(scores, by=["window_id"], prefix="backtest")
