"""Deterministic stratified splits, folds, walk-forward windows and backtests.

Rows are ordered inside their class by a seeded hash (first 60 bits of
md5(id|seed)); a row's position in that order decides its split or fold. The
position comes from ``prefix.running_sums`` (running count over range partitions), so the
two classes -- two huge groups -- never sit in two tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators.prefix import running_sums


def hash_key(id_col: str, seed: int = K.SPLIT_SEED) -> Column:
    """First 60 bits of md5('<id>|<seed>') as a long (same value in SQL engines)."""
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def class_positions(df: DataFrame, label: str = "is_fraud", id_col: str = "transaction_id",
                    seed: int = K.SPLIT_SEED) -> DataFrame:
    """Adds ``_pos`` (1-based position inside the class in hash order) and ``_n_class``."""
    d = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_one", F.lit(1))
    r = running_sums(d, [label], "_h", ["_one"], tiebreak=[id_col])
    return r.withColumnRenamed("run__one", "_pos").withColumnRenamed("tot__one", "_n_class").drop("_one", "_h")


def stratified_split(df: DataFrame, label: str = "is_fraud", id_col: str = "transaction_id",
                     test_size: float = K.TEST_SIZE, val_size: float = K.VAL_SIZE,
                     seed: int = K.SPLIT_SEED) -> DataFrame:
    """L1: adds ``split`` in {train, val, test}, exact per class.

    Unlabelled rows get the split ``unlabelled``. test = ceil(test_size * n_c); val = ceil(val_size / (1 - test_size) * (n_c - test)).
    """
    p = class_positions(df, label, id_col, seed)
    return p.withColumn("split", _split_of(label, test_size, val_size)).drop("_pos", "_n_class")


def _split_of(label: str, test_size: float, val_size: float) -> Column:
    n = F.col("_n_class").cast("double")
    n_test = F.ceil(n * test_size)
    n_val = F.ceil((n - n_test) * (val_size / (1 - test_size)))
    return (F.when(F.col(label).isNull(), "unlabelled").when(F.col("_pos") <= n_test, "test").when(F.col("_pos") <= n_test + n_val, "val")
            .otherwise("train"))


def _fold_of(label: str, k: int) -> Column:
    return F.when(F.col(label).isNotNull(), ((F.col("_pos") - 1) % k).cast("int"))


def stratified_folds(df: DataFrame, k: int = K.CV_FOLDS, label: str = "is_fraud",
                     id_col: str = "transaction_id", seed: int = K.SPLIT_SEED) -> DataFrame:
    """L2: adds ``fold`` in 0..k-1, round-robin over each class's hash order (null: unlabelled)."""
    p = class_positions(df, label, id_col, seed)
    return p.withColumn("fold", _fold_of(label, k)).drop("_pos", "_n_class")


def stratified_split_folds(df: DataFrame, k: int = K.CV_FOLDS, label: str = "is_fraud", id_col: str = "transaction_id",
                           test_size: float = K.TEST_SIZE, val_size: float = K.VAL_SIZE, seed: int = K.SPLIT_SEED) -> DataFrame:
    """L1 and L2 in one pass: both read the same positions."""
    p = class_positions(df, label, id_col, seed)
    return p.withColumns({"split": _split_of(label, test_size, val_size), "fold": _fold_of(label, k)}).drop("_pos", "_n_class")


def class_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """One row with n_neg / n_pos (scale_pos_weight)."""
    return df.agg(F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos")) \
        .withColumn("pos_weight", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")))


def with_weight(df: DataFrame, label: str = "is_fraud", col: str = "weight", counted: DataFrame | None = None) -> DataFrame:
    """Row weights for ``weightCol``: positives get n_neg/n_pos, negatives 1 (one-row broadcast).

    ``counted``: a plainer table with the same rows, to count the classes in."""
    w = class_weight(df if counted is None else counted, label).select("pos_weight")
    return df.crossJoin(F.broadcast(w)).withColumn(
        col, F.when(F.col(label) == 1, F.coalesce("pos_weight", F.lit(1.0))).otherwise(1.0)).drop("pos_weight")


# ---------------------------------------------------------------------------
# walk-forward backtest windows
# ---------------------------------------------------------------------------

def walk_forward_windows(df: DataFrame, ts: str = "timestamp", train_days: int = K.BACKTEST_TRAIN_DAYS,
                         test_days: int = K.BACKTEST_TEST_DAYS, step_days: int = K.BACKTEST_STEP_DAYS) -> DataFrame:
    """L3: one row per window (window_id, train_start, train_end=cut, test_end).

    First cut = min + train_days; cuts every step_days while cut + test_days <= max.
    The table has at most (max - min) / step rows.
    """
    mm = df.agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    first = F.col("_t0") + F.expr(f"INTERVAL {train_days} DAYS")
    last = F.col("_t1") - F.expr(f"INTERVAL {test_days} DAYS")
    cuts = F.when(first <= last, F.sequence(first, last, F.expr(f"INTERVAL {step_days} DAYS"))) \
            .otherwise(F.array().cast("array<timestamp>"))
    w = mm.select(F.posexplode(cuts).alias("_i", "train_end"))
    return w.select((F.col("_i") + 1).alias("window_id"),
                    (F.col("train_end") - F.expr(f"INTERVAL {train_days} DAYS")).alias("train_start"),
                    "train_end",
                    (F.col("train_end") + F.expr(f"INTERVAL {test_days} DAYS")).alias("test_end"))


def assign_windows(df: DataFrame, windows: DataFrame, ts: str = "timestamp", train_days: int = K.BACKTEST_TRAIN_DAYS,
                   test_days: int = K.BACKTEST_TEST_DAYS, step_days: int = K.BACKTEST_STEP_DAYS) -> DataFrame:
    """Rows × the windows that hold them; adds ``role`` train/test.

    Windows begin every ``step_days``, so a row's window numbers follow from its time: only those
    (about (train + test) / step) are made and joined by number, for any lengths.
    """
    day = 86_400_000_000
    first = windows.agg(F.min(F.unix_micros("train_start")).alias("_t0"))
    at = F.unix_micros(F.col(ts)) - F.col("_t0")
    last = F.floor(at / F.lit(step_days * day)) + 1
    lowest = F.greatest(F.floor((at - F.lit((train_days + test_days) * day)) / F.lit(step_days * day)) + 2, F.lit(1))
    d = df.crossJoin(F.broadcast(first)).withColumn("window_id", F.explode(F.when(lowest <= last, F.sequence(lowest, last)))).drop("_t0")
    # a row per window: (max - min) / step of them
    j = d.join(F.broadcast(windows), "window_id")
    return j.withColumn("role", F.when(F.col(ts) < F.col("train_end"), "train").otherwise("test"))


def window_stats(rows: DataFrame, windows: DataFrame, label: str = "is_fraud",
                 min_train_fraud: int = K.BACKTEST_MIN_TRAIN_FRAUD, min_test_fraud: int = K.BACKTEST_MIN_TEST_FRAUD,
                 min_train_rows: int = K.BACKTEST_MIN_TRAIN_ROWS) -> DataFrame:
    """L4: counts per window and the skip rule (fraud counts first, then training size)."""
    tr, te = F.col("role") == "train", F.col("role") == "test"
    y = F.col(label) == 1
    st = rows.groupBy("window_id").agg(
        F.count_if(tr).alias("n_train"), F.count_if(te).alias("n_test"),
        F.count_if(tr & y).alias("n_train_fraud"), F.count_if(te & y).alias("n_test_fraud"))
    out = windows.join(st, "window_id", "left").fillna(0, ["n_train", "n_test", "n_train_fraud", "n_test_fraud"])
    status = (F.when((F.col("n_train_fraud") < min_train_fraud) | (F.col("n_test_fraud") < min_test_fraud),
                     "skipped: insufficient fraud")
              .when(F.col("n_train") < min_train_rows, "skipped: insufficient training data")
              .otherwise("ok"))
    return out.withColumns({
        "train_fraud_rate": F.col("n_train_fraud") / F.greatest(F.col("n_train"), F.lit(1)),
        "status": status})


def skip_reason(n_train: int, n_train_fraud: int, n_test_fraud: int, min_train_fraud: int = K.BACKTEST_MIN_TRAIN_FRAUD,
                min_test_fraud: int = K.BACKTEST_MIN_TEST_FRAUD, min_train_rows: int = K.BACKTEST_MIN_TRAIN_ROWS) -> str | None:
    """The skip rule of ``window_stats`` for one window's counts; None: it is fitted."""
    if n_train_fraud < min_train_fraud or n_test_fraud < min_test_fraud:
        return "skipped: insufficient fraud"
    return "skipped: insufficient training data" if n_train < min_train_rows else None


def backtest_summary(per_window: DataFrame, stable_std: float = K.BACKTEST_STABLE_STD,
                     metrics: Sequence[str] = ("backtest_auc_roc", "backtest_auc_pr", "backtest_recall_optimal")
                     ) -> DataFrame:
    """Mean / population std / min / max of the window metrics; stable if std(AUC-PR) <= .05."""
    ok = per_window.where(F.col("status") == "ok")
    aggs = [F.count(F.lit(1)).alias("windows_completed")]
    for m in metrics:
        short = m.replace("backtest_", "")
        aggs += [F.avg(m).alias(f"{short}_mean"), F.stddev_pop(m).alias(f"{short}_std"),
                 F.min(m).alias(f"{short}_min"), F.max(m).alias(f"{short}_max")]
    return ok.agg(*aggs).withColumn("stable", (F.col("auc_pr_std") <= stable_std).cast("int"))


def aligned(train_days: int = K.BACKTEST_TRAIN_DAYS, test_days: int = K.BACKTEST_TEST_DAYS,
            step_days: int = K.BACKTEST_STEP_DAYS) -> bool:
    """Windows tile the timeline in step buckets: test = step, train a multiple of step."""
    return test_days == step_days and train_days % step_days == 0


def _step_bucket(windows: DataFrame, ts: str, step_days: int):
    first = windows.agg(F.min("train_end").alias("_c0"))
    step_us = step_days * 86_400_000_000
    b = F.floor((F.unix_micros(F.col(ts)) - F.unix_micros(F.col("_c0"))) / F.lit(step_us))
    return first, b


def test_rows(df: DataFrame, windows: DataFrame, ts: str = "timestamp", step_days: int = K.BACKTEST_STEP_DAYS
              ) -> DataFrame:
    """Each row's test window by arithmetic (aligned windows): no range join, no row copies."""
    first, b = _step_bucket(windows, ts, step_days)
    d = df.crossJoin(F.broadcast(first)).withColumn("window_id", (b + 1).cast("long")).drop("_c0")
    return d.join(F.broadcast(windows.select("window_id")), "window_id", "left_semi").withColumn("role", F.lit("test"))


def window_stats_aligned(df: DataFrame, windows: DataFrame, label: str = "is_fraud", ts: str = "timestamp",
                         train_days: int = K.BACKTEST_TRAIN_DAYS, step_days: int = K.BACKTEST_STEP_DAYS,
                         min_train_fraud: int = K.BACKTEST_MIN_TRAIN_FRAUD,
                         min_test_fraud: int = K.BACKTEST_MIN_TEST_FRAUD,
                         min_train_rows: int = K.BACKTEST_MIN_TRAIN_ROWS) -> DataFrame:
    """L4 from per-step-bucket counts: window k tests bucket k-1 and trains on the
    train_days/step buckets before it (sums over a table of one row per bucket)."""
    first, b = _step_bucket(windows, ts, step_days)
    per = (df.crossJoin(F.broadcast(first)).groupBy(b.alias("_b"))
             .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_f")))
    k = train_days // step_days
    w = windows.withColumn("_tb", F.col("window_id") - 1)
    j = w.join(F.broadcast(per), (per["_b"] >= F.col("_tb") - k) & (per["_b"] <= F.col("_tb")), "left")
    tr, te = F.col("_b") < F.col("_tb"), F.col("_b") == F.col("_tb")
    st = j.groupBy(*windows.columns).agg(
        F.coalesce(F.sum(F.when(tr, F.col("_n"))), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum(F.when(te, F.col("_n"))), F.lit(0)).alias("n_test"),
        F.coalesce(F.sum(F.when(tr, F.col("_f"))), F.lit(0)).alias("n_train_fraud"),
        F.coalesce(F.sum(F.when(te, F.col("_f"))), F.lit(0)).alias("n_test_fraud"))
    status = (F.when((F.col("n_train_fraud") < min_train_fraud) | (F.col("n_test_fraud") < min_test_fraud),
                     "skipped: insufficient fraud")
              .when(F.col("n_train") < min_train_rows, "skipped: insufficient training data")
              .otherwise("ok"))
    return st.withColumns({"train_fraud_rate": F.col("n_train_fraud") / F.greatest(F.col("n_train"), F.lit(1)),
                           "status": status})
