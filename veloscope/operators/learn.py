"""Model fitting on Spark ML.

The feature matrix becomes a ``Transformer`` so the whole path
(features → label encoding → vector) is one ``Pipeline`` that fits on the
training split and persists with ``PipelineModel.save``. Learners are the
MLlib estimators; folds, weights and metrics come from this package's own
operators, so cross-validation never moves data to the driver (only fitted
models and one metric row per fold do).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCols, Param, Params, TypeConverters
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators import evaluation as EV
from veloscope.operators.features import feature_matrix, feature_names
from veloscope.operators.prefix import running_sums
from veloscope.session import written_once

CATEGORICAL = ("currency", "merchant_category", "country")
UNKNOWN = "__UNKNOWN__"


class FeatureMatrixTransformer(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """F0/F6 as a pipeline stage (stateless: every statistic is computed from the rows it sees)."""

    windows = Param(Params._dummy(), "windows", "velocity windows in hours", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, windows: list[int] | None = None):
        super().__init__()
        self._setDefault(windows=list(K.VELOCITY_WINDOWS_HOURS))
        kwargs = self._input_kwargs
        self._set(**{k: v for k, v in kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        out = feature_matrix(df, windows=self.getOrDefault("windows"))
        # nulls become the explicit unknown label before encoding
        return out.fillna(UNKNOWN, [c for c in CATEGORICAL if c in out.columns])


def numeric_features(windows: Sequence[int] = K.VELOCITY_WINDOWS_HOURS) -> list[str]:
    return [n for n in feature_names(windows) if n not in CATEGORICAL]


def feature_pipeline(windows: Sequence[int] = K.VELOCITY_WINDOWS_HOURS, out_col: str = "features") -> Pipeline:
    """features → alphabetical label codes (unseen / null → the extra index) → vector."""
    idx = [f"{c}_idx" for c in CATEGORICAL]
    return Pipeline(stages=[
        FeatureMatrixTransformer(windows=list(windows)),
        StringIndexer(inputCols=list(CATEGORICAL), outputCols=idx, stringOrderType="alphabetAsc",
                      handleInvalid="keep"),
        VectorAssembler(inputCols=numeric_features(windows) + idx, outputCol=out_col, handleInvalid="keep"),
    ])


def label_codes(train: DataFrame, df: DataFrame, cols: Sequence[str] = CATEGORICAL) -> DataFrame:
    """F3/F4 as plain columns: code = alphabetical position among the training values
    (null → '__UNKNOWN__'); values unseen in training get the number of labels.

    The values of all columns are collected in one unpivoted pass and numbered by running counts, so a
    column with very many values is no single task's sort; how the codes are joined is left to the optimizer.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), text(c).alias("v")) for c in cols])).alias("x")).select("x.*")
    codes = written_once(running_sums(long.distinct().withColumn("one", F.lit(1)), ["c"], "v", ["one"])
                         .select("c", "v", (F.col("run_one") - 1).cast("double").alias("code")), "codes")
    n = {r["c"]: float(r["n"]) for r in codes.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}     # a row per column
    out = df
    for c in cols:
        mine = codes.where(F.col("c") == c).select(F.col("v").alias("_k"), F.col("code").alias(f"{c}_idx"))
        out = out.withColumn("_k", text(c)).join(mine, "_k", "left").drop("_k") \
            .withColumn(f"{c}_idx", F.coalesce(f"{c}_idx", F.lit(n.get(c, 0.0))))
    return out


def standard_scale(train: DataFrame, df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """(x - mean) / population std fitted on ``train`` (std 0 → 1), as columns.

    MLlib's StandardScaler divides by the sample std; the population form is
    kept here so scaled values equal the reference definition.
    """
    stats = train.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)],
                      *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(stats))
    for i, c in enumerate(cols):
        sd = F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(F.lit(1.0))
        j = j.withColumn(f"{c}{suffix}", (F.col(c) - F.col(f"_m{i}")) / sd)
    return j.drop(*[x for x in j.columns if x.startswith(("_m", "_s")) and x[2:].isdigit()])


def top_k_features(importances: DataFrame, k: int = 80, min_importance: float = 0.001) -> DataFrame:
    """F8: the k most important features above a floor."""
    return importances.where(F.col("importance") >= min_importance).orderBy(
        F.col("importance").desc(), F.col("feature")).limit(k)


def feature_importances(model, names: Sequence[str]) -> DataFrame:
    """(feature, importance) rows sorted by importance (one row per feature)."""
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "feature string, importance double")


def p1(col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


def gbt(features: str = "features", label: str = "is_fraud", weight: str | None = "weight",
        validation: str | None = None, max_iter: int = 50, max_depth: int = 5, step: float = 0.1) -> GBTClassifier:
    """Boosted trees; with a validation indicator column MLlib stops early (validationTol)."""
    g = GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                      seed=K.SPLIT_SEED)
    if weight:
        g = g.setWeightCol(weight)
    if validation:
        g = g.setValidationIndicatorCol(validation)
    return g


def calibrate(val_scored: DataFrame, label: str = "is_fraud", prob: str = "p_raw"):
    """Isotonic map from raw probability to calibrated probability, fitted on validation rows."""
    return IsotonicRegression(featuresCol=prob, labelCol=label, predictionCol="p_calibrated").fit(
        val_scored.select(F.col(prob).cast("double").alias(prob), F.col(label).cast("double").alias(label)))


class WidthPerceptron(Estimator):
    """A multilayer perceptron whose first layer takes the width of the vectors it is fitted on."""

    def __init__(self, features: str = "features", label: str = "is_fraud", hidden: int = 16, max_iter: int = 50):
        super().__init__()
        self.features, self.label, self.hidden, self.max_iter = features, label, hidden, max_iter

    def _fit(self, df: DataFrame) -> PipelineModel:
        width = len(df.select(self.features).first()[0])
        scale = StandardScaler(inputCol=self.features, outputCol="mlp_x", withMean=True)
        mlp = MultilayerPerceptronClassifier(featuresCol="mlp_x", labelCol=self.label, layers=[width, self.hidden, 2],
                                             maxIter=self.max_iter, seed=K.SPLIT_SEED)
        return Pipeline(stages=[scale, mlp]).fit(df)


def base_learners(features: str = "features", label: str = "is_fraud", weight: str = "weight",
                  max_iter: int = 20, validation: str | None = None, mlp: bool = True) -> dict[str, Estimator]:
    """The stack's base learners; ``validation`` names the indicator column that boosting stops on."""
    out = {
        "gbt": gbt(features, label, weight, validation, max_iter=max_iter, max_depth=4),
        "lr": LogisticRegression(featuresCol=features, labelCol=label, weightCol=weight, maxIter=50, regParam=0.01),
    }
    return out | ({"mlp": WidthPerceptron(features, label, max_iter=max_iter)} if mlp else {})


def side_by_side(df: DataFrame, models: dict) -> DataFrame:
    """H7: the probabilities of several fitted models as columns ``p_<name>`` (no joins)."""
    for n, m in models.items():
        df = m.transform(df).withColumn(f"p_{n}", p1()).drop("rawPrediction", "probability", "prediction", "mlp_x")
    return df


def out_of_fold(df: DataFrame, learners: dict[str, Estimator], k: int, fold_col: str = "fold",
                id_col: str = "transaction_id") -> DataFrame:
    """L11 step 1: out-of-fold scores of every base learner (k fits per learner)."""
    parts = []
    for f in range(k):
        tr, te = df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)
        pred = side_by_side(te, {name: est.fit(tr) for name, est in learners.items()})
        parts.append(pred.select(id_col, "is_fraud", "weight", *[f"p_{n}" for n in learners]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stacking(df: DataFrame, learners: dict[str, Estimator] | None = None, k: int = K.CV_FOLDS,
             id_col: str = "transaction_id"):
    """Base learners' out-of-fold scores → balanced logistic meta model; bases refit on all rows.

    Returns (base models, meta pipeline model, out-of-fold table)."""
    learners = learners or base_learners()
    oof = out_of_fold(df, learners, k, id_col=id_col)
    meta = Pipeline(stages=[VectorAssembler(inputCols=[f"p_{n}" for n in learners], outputCol="meta_x"),
                            LogisticRegression(featuresCol="meta_x", labelCol="is_fraud", weightCol="weight",
                                               predictionCol="meta_pred", probabilityCol="meta_probability",
                                               rawPredictionCol="meta_raw")]).fit(oof)
    bases = {n: est.fit(df) for n, est in learners.items()}
    return bases, meta, oof


def ensemble_predict(df: DataFrame, bases: dict, meta: PipelineModel, id_col: str = "transaction_id") -> DataFrame:
    """Base probabilities side by side (H7) → meta model → fraud_probability."""
    return meta.transform(side_by_side(df, bases)).withColumn("fraud_probability", p1("meta_probability"))


def compare_models(df: DataFrame, k: int = K.CV_FOLDS, fold_col: str = "fold",
                   id_col: str = "transaction_id") -> DataFrame:
    """LR / RF / GBT with k folds: mean and population std of AUC-PR, AUC-ROC and
    precision at 80 % recall per model, ranked by mean AUC-PR."""
    models = {
        "logistic_regression": LogisticRegression(featuresCol="features", labelCol="is_fraud", weightCol="weight",
                                                  maxIter=50),
        "random_forest": RandomForestClassifier(featuresCol="features", labelCol="is_fraud", weightCol="weight",
                                                numTrees=30, maxDepth=6, seed=K.SPLIT_SEED),
        "gbt": gbt(max_iter=20, max_depth=4),
    }
    scored = []
    for name, est in models.items():
        for f in range(k):
            tr, te = df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)
            pred = est.fit(tr).transform(te).select(F.lit(name).alias("model"), F.lit(f).alias("fold"), "is_fraud", p1().alias("p"))
            scored.append(written_once(pred, "scores"))         # scored once, and all curves in one pass
    by = ["model", "fold"]
    folds = EV.curve_metrics(EV.score_curve(reduce(DataFrame.unionByName, scored), score="p", by=by), by)
    summary = folds.groupBy("model").agg(
        *[fn(c).alias(f"{c}_{s}") for c in ("auc_pr", "auc_roc", "prec_at_80recall")
          for s, fn in (("mean", F.avg), ("std", F.stddev_pop))])
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(F.col("auc_pr_mean").desc())))


#: what a search draws from, by setting of the boosted trees: (low, high) or a list of choices
SEARCH_SPACE = {"maxIter": (10, 60), "maxDepth": (3, 8), "stepSize": (0.01, 0.3), "subsamplingRate": (0.5, 1.0),
                "featureSubsetStrategy": ["all", "sqrt", "onethird"], "minInstancesPerNode": (1, 20), "minInfoGain": (0.0, 0.05),
                "maxBins": [32, 64, 128], "minWeightFractionPerNode": (0.0, 0.02)}


def sampled_settings(n_trials: int, seed: int, space: dict | None = None) -> list[dict]:
    """``n_trials`` seeded draws of all settings (step sizes on a log scale)."""
    import math
    import random
    rng, out = random.Random(seed), []
    for _ in range(n_trials):
        d = {}
        for k, v in (space or SEARCH_SPACE).items():
            if isinstance(v, list):
                d[k] = rng.choice(v)
            elif isinstance(v[0], int):
                d[k] = rng.randint(*v)
            else:
                d[k] = math.exp(rng.uniform(math.log(v[0]), math.log(v[1]))) if k == "stepSize" else rng.uniform(*v)
        out.append(d)
    return out


def random_search(df: DataFrame, n_trials: int = 100, k: int = 3, seed: int = K.SPLIT_SEED, parallelism: int = 2,
                  space: dict | None = None):
    """Random search over the boosted trees' settings, scored by k-fold CV (MLlib CrossValidator with a fold column)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    est = gbt()
    maps = [{est.getParam(name): v for name, v in d.items()} for d in sampled_settings(n_trials, seed, space)]
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, numFolds=k, foldCol="fold", parallelism=parallelism,
                        evaluator=BinaryClassificationEvaluator(labelCol="is_fraud", metricName="areaUnderPR"))
    return cv.fit(df.withColumn("fold", (F.col("fold") % k).cast("int")))


def search_results(model) -> DataFrame:
    """One row per trial: its settings as JSON, its mean score, its rank (ties: the earlier trial)."""
    import json
    spark = SparkSession.getActiveSession()
    rows = [(i, json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(s))
            for i, (m, s) in enumerate(zip(model.getEstimatorParamMaps(), model.avgMetrics))]
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    rank = {r[0]: n + 1 for n, r in enumerate(order)}
    return spark.createDataFrame([(*r, rank[r[0]]) for r in rows], "trial int, settings string, auc_pr double, rank int")


def mlp_on_categories(df: DataFrame, cat_idx: Sequence[str], numeric: Sequence[str], hidden: int = 16,
                      max_iter: int = 50) -> PipelineModel:
    """One-hot categorical codes + numeric features → multilayer perceptron (fitted)."""
    oh = [f"{c}_oh" for c in cat_idx]
    prep = Pipeline(stages=[
        OneHotEncoder(inputCols=list(cat_idx), outputCols=oh, handleInvalid="keep"),
        VectorAssembler(inputCols=list(numeric) + oh, outputCol="mlp_x", handleInvalid="keep"),
    ]).fit(df)
    width = len(prep.transform(df.limit(1)).first()["mlp_x"])
    mlp = MultilayerPerceptronClassifier(featuresCol="mlp_x", labelCol="is_fraud", layers=[width, hidden, 2],
                                         maxIter=max_iter, seed=K.SPLIT_SEED)
    return PipelineModel(stages=[*prep.stages, mlp.fit(prep.transform(df))])
