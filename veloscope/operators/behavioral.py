"""Behavioural profile features.

All profile statistics are over the user's whole table (the reference's
parity mode); ``user_profile`` returns them as a table, ``behavioral_columns``
attaches them to rows with the physical shape chosen by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloscope.functions import columns as C
from veloscope.operators.prefix import running_sums
from veloscope.operators.profile import JOIN, attach, distinct, is_first
from veloscope.operators.skew import DEFAULT_HOT_ROWS, NULL_SALT, dealt, split_hot
from veloscope.operators.temporal import US, salted, with_micros

USER = "user_id"


def user_aggs(df: DataFrame) -> dict[str, Column]:
    """D1 + D9 + E11 aggregates of one user (usable over a window or in groupBy)."""
    night = F.col("is_night") if "is_night" in df.columns else F.coalesce(C.is_night("timestamp"), F.lit(0))
    aggs = {
        "_u_mean": F.avg("amount"),
        "_u_std": F.stddev_samp("amount"),
        "_u_median": F.median("amount"),
        "_u_count": F.count("transaction_id"),
        "_u_rows": F.count(F.lit(1)),
        "_u_night": F.avg(night),
        "_u_spend": F.sum("amount"),
        # Mean of daily sums over active days = spend on dated rows / active days
        "_u_dated_spend": F.sum(F.when(F.col("timestamp").isNotNull(), F.col("amount"))),
        "_u_days": distinct(F.to_date("timestamp")),
    }
    if "device_fingerprint" in df.columns:
        aggs["_u_devices"] = distinct(F.col("device_fingerprint"))
    return aggs


def user_profile(df: DataFrame) -> DataFrame:
    """D1 as a table: one row per user (partial aggregation, skew-safe)."""
    df = _with_night(df)
    a = user_aggs(df)
    return (df.where(F.col(USER).isNotNull()).groupBy(USER).agg(
        a["_u_mean"].alias("user_avg_amount"),
        F.coalesce(a["_u_std"], F.lit(0.0)).alias("user_std_amount"),
        a["_u_median"].alias("user_median_amount"),
        a["_u_count"].alias("user_txn_count"),
        a["_u_night"].alias("user_night_ratio"),
        F.coalesce(a["_u_spend"], F.lit(0.0)).alias("user_total_spend"),
    ))


def _with_night(df: DataFrame) -> DataFrame:
    if "is_night" in df.columns:
        return df
    return df.withColumn("is_night", F.coalesce(C.is_night("timestamp"), F.lit(0)))


def behavioral_columns(df: DataFrame, mode: str = "full") -> dict[str, Column]:
    """D3-D7, D9 from the attached aggregates (of the whole table, or point in time of the earlier rows)."""
    out = {
        "amount_vs_user_avg": F.coalesce(C.safe_ratio("amount", "_u_mean"), F.lit(0.0)),
        "amount_vs_user_median": F.coalesce(C.safe_ratio("amount", "_u_median"), F.lit(0.0)),
        "user_night_txn_ratio": F.coalesce(F.col("_u_night"), F.lit(0.0)),
        "user_total_spend": F.coalesce(F.col("_u_spend"), F.lit(0.0)),
        "user_txn_count": F.coalesce(F.col("_u_count"), F.lit(0)),
    }
    if "merchant_category" in df.columns:
        out["category_frequency_ratio"] = F.coalesce(C.safe_ratio("_uc_count", "_u_count"), F.lit(0.0))
        out["is_new_category"] = is_first("_uc_count", mode)
    else:
        out["category_frequency_ratio"] = F.lit(0.5)
        out["is_new_category"] = F.lit(0)
    out["avg_daily_spend"] = F.coalesce(
        F.when(F.col("_u_days") > 0, F.coalesce(F.col("_u_dated_spend"), F.lit(0.0)) / F.col("_u_days")),
        F.lit(0.0))
    return out


def spend_percentile(df: DataFrame, user: str = USER, id_col: str = "transaction_id",
                     hot_threshold: int | None = DEFAULT_HOT_ROWS) -> DataFrame:
    """Expanding rank of the amount in the user's history up to this row.

    #(earlier-or-own amounts <= amount) / position, in (time, id) order; a
    user with one row (or a null user) gets 0.5, a null amount 0. The window's history is quadratic in a user's rows:
    users above ``hot_threshold`` rows take the distributed shape (``None``: no user does).
    """
    split = split_hot(with_micros(df), [user], hot_threshold)
    out = dealt(salted(split.normal, user), split.n_rows, user, NULL_SALT).withColumns(spend_percentile_columns(user, id_col)).drop(NULL_SALT)
    if split.hot is None:
        return out
    return out.unionByName(spend_percentile_distributed(split.hot, user, id_col).select(*out.columns))


def spend_percentile_columns(user: str = USER, id_col: str = "transaction_id") -> dict[str, Column]:
    wu = Window.partitionBy(user, NULL_SALT)
    wt = wu.orderBy(F.col(US).asc_nulls_last(), F.col(id_col))
    run = wt.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = F.collect_list("amount").over(run)
    le = F.size(F.filter(hist, lambda x: x <= F.col("amount")))
    pct = le / F.row_number().over(wt)
    return {"spend_percentile": F.when(
        F.col(user).isNull() | (F.count(F.lit(1)).over(wu) <= 1), F.lit(0.5)).otherwise(pct)}


def intl_txn_ratio(df: DataFrame, how: str = JOIN, home: str = "US") -> DataFrame:
    """M2: share of the user's transactions outside the home country (null country counts)."""
    if "country" not in df.columns:
        return df.withColumn("intl_txn_ratio", F.lit(0.0))
    intl = (~F.col("country").eqNullSafe(home)).cast("int")
    return attach(df.withColumn("_intl", intl), [USER], {"intl_txn_ratio": F.avg("_intl")}, how) \
        .withColumn("intl_txn_ratio", F.coalesce("intl_txn_ratio", F.lit(0.0))).drop("_intl")


def preferred_payment_match(df: DataFrame) -> DataFrame:
    """M3: 1 when payment_method equals the user's most frequent one (ties: smallest value).

    The per-user mode comes from a (user, method) count aggregate and a
    ranking over that small table, then a join: no per-user task over raw rows.
    """
    if "payment_method" not in df.columns:
        return df.withColumn("preferred_payment_match", F.lit(1))
    counts = (df.where(F.col(USER).isNotNull() & F.col("payment_method").isNotNull())
                .groupBy(USER, "payment_method").agg(F.count(F.lit(1)).alias("_n")))
    mode = (counts.groupBy(USER)
                  .agg(F.min_by("payment_method", F.struct(-F.col("_n"), F.col("payment_method")))
                       .alias("_pref")))
    out = df.join(mode, USER, "left")
    return out.withColumn("preferred_payment_match",
                          F.coalesce((F.col("payment_method") == F.col("_pref")).cast("int"), F.lit(0))
                          ).drop("_pref")


def spend_percentile_distributed(df: DataFrame, user: str = USER, id_col: str = "transaction_id",
                                 block: int = 2048) -> DataFrame:
    """D8 for hot users: the same expanding rank without any per-user task.

    #(earlier-or-own amounts <= a) is a two-dimensional dominance count. Rows
    get their position p in (time, id) order from running counts and a
    block number b = (p - 1) // block:

    * inside the own block the bounded window does the counting (<= block rows);
    * earlier blocks [0, b) are covered by the Fenwick decomposition of b: for
      every set bit l of b one node ((b >> l) - 1) at level l. Each row is a data
      point of its node at every level and a query at the levels of its set
      bits; per (user, level, node) a running count of data points in
      amount order, read at each query, gives the rows with amount <= a there.

    Work grows as rows x log2(blocks); no group larger than a range partition or a block
    is ever ordered in one task.
    """
    d = with_micros(df).withColumns({"_one": F.lit(1), "_row": F.monotonically_increasing_id()})
    r = running_sums(d, [user], US, ["_one"], tiebreak=[id_col]) \
        .withColumnRenamed("run__one", "_pos").withColumnRenamed("tot__one", "_n")
    r = r.withColumn("_blk", F.floor((F.col("_pos") - 1) / block).cast("long"))
    wb = (Window.partitionBy(user, "_blk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = r.withColumn("_within", F.size(F.filter(F.collect_list("amount").over(wb), lambda x: x <= F.col("amount"))))
    nb_max = F.floor((F.col("_n") - 1) / block).cast("long")
    levels = F.when(nb_max > 0, F.length(F.bin(nb_max))).otherwise(0)
    base = r.where(F.col("amount").isNotNull() & (levels > 0)).select(
        user, "_row", "amount", "_blk", F.explode(F.sequence(F.lit(0), levels - 1)).alias("_lvl"))
    scale = F.pow(F.lit(2.0), F.col("_lvl"))
    data = base.select(user, F.col("_lvl"), F.floor(F.col("_blk") / scale).cast("long").alias("_node"),
                       "amount", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_qid"), F.lit(1).alias("_d"))
    bit = (F.floor(F.col("_blk") / scale) % 2) == 1
    query = base.where(bit).select(user, F.col("_lvl"), (F.floor(F.col("_blk") / scale) - 1).cast("long").alias("_node"),
                                   "amount", F.lit(1).alias("_kind"), F.col("_row").alias("_qid"), F.lit(0).alias("_d"))
    cnt = running_sums(data.unionByName(query), [user, "_lvl", "_node"], "amount", ["_d"], tiebreak=["_kind"])
    earlier = cnt.where(F.col("_kind") == 1).groupBy(F.col("_qid").alias("_row")).agg(
        F.sum("run__d").alias("_earlier"))
    out = r.join(earlier, "_row", "left")
    pct = (F.col("_within") + F.coalesce(F.col("_earlier"), F.lit(0))) / F.col("_pos")
    return out.withColumn("spend_percentile", F.when(F.col(user).isNull() | (F.col("_n") <= 1), F.lit(0.5))
                          .otherwise(pct)).drop("_one", "_row", "_pos", "_n", "_blk", "_within", "_earlier")
