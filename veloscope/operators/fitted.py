"""Fitted features (F7): what fit learns is stored, transform joins it.

``fit`` keeps three profile tables (user; user and category; user and merchant) and the rows of the largest
velocity window before the end of the training period. ``transform`` computes the velocity and recency of new events
over stored rows plus the new ones, and takes every profile statistic from the tables, so one event is scored
against its user's history and no statistic of the scored batch leaks into it. A user, category or merchant
without a stored profile gets the null-row values of the feature matrix; ``is_new_*`` means unseen at fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators import behavioral as B
from veloscope.operators import transaction as X
from veloscope.operators.features import BASE, compute_features, feature_names
from veloscope.operators.prefix import exact_quantiles
from veloscope.operators.profile import grouped
from veloscope.operators.temporal import DAY_US, HOUR_US, US, with_micros

TABLES = ("users", "categories", "merchants", "recent")
KEPT = ("transaction_id", "user_id", "amount", "currency", "merchant_id", "merchant_category", "timestamp", "is_fraud",
        "payment_method", "card_present", "device_fingerprint", "country", "latitude", "longitude")


@dataclass
class FittedFeatures:
    users: DataFrame
    categories: DataFrame
    merchants: DataFrame
    recent: DataFrame
    windows: tuple = tuple(K.VELOCITY_WINDOWS_HOURS)

    def save(self, path: str) -> None:
        for t in TABLES[:-1]:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")
        self.recent.write.mode("overwrite").parquet(f"{path}/recent/batch=-1")
        spark = self.users.sparkSession
        spark.createDataFrame([(list(self.windows),)], "windows array<int>").write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str, before: int | None = None) -> FittedFeatures:
        """The stored tables; recent rows of batches below ``before`` only."""
        w = spark.read.schema("windows array<int>").json(f"{path}/settings").first()["windows"]
        recent = spark.read.parquet(f"{path}/recent")
        recent = recent if before is None else recent.where(F.col("batch") < before)
        return cls(*[spark.read.parquet(f"{path}/{t}") for t in TABLES[:-1]], recent.drop("batch"), windows=tuple(w))

    def observe(self, events: DataFrame, path: str, batch: int) -> None:
        """Add the events of a batch to the stored recent rows (a folder per batch: repeating it changes nothing)."""
        cols = self.recent.columns
        have = {c: F.col(c) if c in events.columns else F.lit(None) for c in cols}
        types = {f.name: f.dataType for f in self.recent.schema.fields}
        events.select(*[c.cast(types[k]).alias(k) for k, c in have.items()]).write.mode("overwrite") \
            .parquet(f"{path}/recent/batch={batch}")

    def transform(self, events: DataFrame) -> DataFrame:
        """Ids, label and the model features of ``events`` (the columns of ``feature_matrix``, in its order)."""
        ids = [c for c in ("transaction_id", "user_id", "merchant_id", "timestamp", "is_fraud") if c in events.columns]
        old = [c for c in self.recent.columns if c in events.columns]
        ctx = self.recent.select(*old).withColumn("_new", F.lit(0)).unionByName(
            events.withColumn("_new", F.lit(1)), allowMissingColumns=True)
        more = [c for c in events.columns if c not in (*ids, *BASE)]
        # the percentile comes from the windows of the other features: no second shuffle of the context, and none where it is not read
        now = compute_features(ctx, groups=("calendar", "velocity", "recency"), windows=self.windows, keep=("_new", "spend_percentile", *more))
        d = now.where("_new = 1").drop("_new")
        d = with_micros(d).join(self.users, "user_id", "left")
        d = d.join(self.categories, ["user_id", "merchant_category"], "left") if "merchant_category" in d.columns else d
        d = d.join(self.merchants, ["user_id", "merchant_id"], "left")
        d = d.withColumns({
            "seconds_since_last_txn": F.when(F.col("seconds_since_last_txn") >= 0, F.col("seconds_since_last_txn")).otherwise(
                F.coalesce(F.when(F.col("_u_last") <= F.col(US), (F.col(US) - F.col("_u_last")) / 1e6), F.lit(-1.0))),
            "days_since_first_txn": F.when(F.col("_u_first") <= F.col(US), (F.col(US) - F.col("_u_first")) / float(DAY_US))
                                     .otherwise(F.col("days_since_first_txn")),
        })
        if "_u_devices" not in d.columns:                   # the history had no device column
            d = d.withColumn("_u_devices", F.lit(None).cast("int"))
        derived = {**B.behavioral_columns(d), **X.transaction_columns(d), **X.geo_columns(d), **X.device_columns(d)}
        derived["is_new_category"] = F.col("_uc_count").isNull().cast("int")
        derived["is_new_merchant"] = F.col("_um_count").isNull().cast("int")
        d = d.withColumns(derived)
        names = [n for n in feature_names(self.windows) if n in d.columns]
        numeric = {"currency", "merchant_category", "country"}
        return d.select(*[c for c in ids if c not in names],
                        *[F.col(n) if n in numeric else F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


def fit_features(history: DataFrame, windows: Sequence[int] = K.VELOCITY_WINDOWS_HOURS) -> FittedFeatures:
    """Profiles of ``history`` (training rows) and its rows within the largest window before its end."""
    h = B._with_night(with_micros(history)).where(F.col("user_id").isNotNull())
    aggs = B.user_aggs(h)
    aggs.pop("_u_median")
    users = h.groupBy("user_id").agg(*grouped(aggs), F.min(US).alias("_u_first"), F.max(US).alias("_u_last"))
    median = exact_quantiles(h, ["user_id"], "amount", [0.5], prefix="_u_median")
    users = users.join(median.select("user_id", F.col("_u_median0").alias("_u_median")), "user_id", "left")
    per = lambda key, name: h.where(F.col(key).isNotNull()).groupBy("user_id", key).agg(F.count(F.lit(1)).alias(name))
    end = h.agg(F.max(US).alias("_end"))
    recent = h.crossJoin(F.broadcast(end)).where(F.col(US) > F.col("_end") - max(windows) * HOUR_US)
    return FittedFeatures(users, per("merchant_category", "_uc_count"), per("merchant_id", "_um_count"),
                          recent.select(*[c for c in KEPT if c in history.columns]), tuple(windows))


