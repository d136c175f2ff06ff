"""Model registry as a table.

A registry is a DataFrame with (name, version, stage, run_id,
creation_timestamp, description, metrics map<string,double>,
tags map<string,string>). Every operation is a table transform that returns
the next version of the table; persisting it (parquet / a catalog table) is
the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veloscope import constants as K

STAGES = ("None", "Staging", "Production", "Archived")


def list_versions(reg: DataFrame, stage: str | None = None) -> DataFrame:
    """Versions newest first (``rank`` 1 = newest) with an optional stage filter."""
    r = reg.where(F.col("stage") == stage) if stage else reg
    w = Window.partitionBy("name").orderBy(F.col("version").desc())
    return r.withColumn("rank", F.row_number().over(w))


def latest_version(reg: DataFrame, stage: str) -> DataFrame:
    """Newest version per name in a stage."""
    return (reg.where(F.col("stage") == stage).groupBy("name")
               .agg(F.max("version").alias("version")))


def version_by_id(reg: DataFrame, name: str, version: int) -> DataFrame:
    """One version of a model (no row if it does not exist)."""
    return reg.where((F.col("name") == name) & (F.col("version") == version))


def metric(col: str = "metrics", key: str = "auc_pr"):
    """A metric from the map; absent → 0."""
    return F.coalesce(F.try_element_at(F.col(col), F.lit(key)), F.lit(0.0))


def compare_versions(reg: DataFrame, key: str = "auc_pr") -> DataFrame:
    """Versions ranked by a metric (desc, absent = 0; ties by newer version)."""
    w = Window.partitionBy("name").orderBy(metric(key=key).desc(), F.col("version").desc())
    return reg.withColumn(key, metric(key=key)).withColumn("rank", F.row_number().over(w))


def best_version(reg: DataFrame, key: str = "auc_pr") -> DataFrame:
    """Best version per name by a metric (ties: newest)."""
    return reg.groupBy("name").agg(
        F.max_by("version", F.struct(metric(key=key), F.col("version"))).alias("version"),
        F.max(metric(key=key)).alias(key))


def promote(reg: DataFrame, name: str, version: int, stage: str = "Production",
            archive_existing: bool = True) -> DataFrame:
    """Move one version to ``stage``; other holders of that stage are archived. A version that does not exist changes nothing."""
    target = (F.col("name") == name) & (F.col("version") == version)
    there = F.max(target).over(Window.partitionBy("name"))
    others = (F.col("name") == name) & (F.col("version") != version) & (F.col("stage") == stage)
    new_stage = F.when(target, F.lit(stage))
    if archive_existing:
        new_stage = new_stage.when(others & there, F.lit("Archived"))
    return reg.withColumn("stage", new_stage.otherwise(F.col("stage")))


def archive(reg: DataFrame, name: str, version: int) -> DataFrame:
    """Retire one version."""
    it = (F.col("name") == name) & (F.col("version") == version)
    return reg.withColumn("stage", F.when(it, F.lit("Archived")).otherwise(F.col("stage")))


def staging_to_production(reg: DataFrame) -> DataFrame:
    """Per model, the newest staging version takes production and its former holders are archived."""
    new = latest_version(reg, "Staging").select("name", F.col("version").alias("_new"))
    st = (F.when((F.col("stage") == "Staging") & (F.col("version") == F.col("_new")), F.lit("Production"))
          .when((F.col("stage") == "Production") & F.col("_new").isNotNull(), F.lit("Archived")).otherwise(F.col("stage")))
    return reg.join(new, "name", "left").withColumn("stage", st).drop("_new")


def promote_best(reg: DataFrame, key: str = "auc_pr", stage: str = "Production") -> DataFrame:
    """L22 for every name at once: the best version by ``key`` takes ``stage``, former holders are archived."""
    best = best_version(reg, key).select("name", F.col("version").alias("_best"))
    j = reg.join(best, "name", "left")
    st = (F.when(F.col("version") == F.col("_best"), F.lit(stage))
          .when(F.col("stage") == stage, F.lit("Archived")).otherwise(F.col("stage")))
    return j.withColumn("stage", st).drop("_best")


def register(reg: DataFrame, new: DataFrame) -> DataFrame:
    """Append new rows (name, run_id, description, metrics, tags, creation_timestamp);
    versions continue after the current maximum per name, in creation order."""
    cur = reg.groupBy("name").agg(F.max("version").alias("_v0"))
    w = Window.partitionBy("name").orderBy("creation_timestamp", "run_id")
    add = (new.join(cur, "name", "left")
              .withColumn("version", F.coalesce("_v0", F.lit(0)) + F.row_number().over(w))
              .withColumn("stage", F.lit("None")).drop("_v0"))
    return reg.unionByName(add.select(*reg.columns))


def quality_gate(metrics: DataFrame, key: str = "test_auc_pr", register_min: float = K.REGISTER_MIN_AUC_PR,
                 fail_below: float = K.FAIL_BELOW_AUC_PR) -> DataFrame:
    """Decision per metric row: register (>= .85), keep (>= .70) or fail (< .70, absent or not a number)."""
    v = F.nanvl(F.col(key).cast("double"), F.lit(None).cast("double"))
    return metrics.withColumn("gate", F.when(v >= register_min, "register").when(v >= fail_below, "keep")
                              .otherwise("fail"))
