"""Documents to training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared
checkpoint folder and reads it again as the next stage's documents. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscope.llm import decontaminate, materialise, mixing, quality, simhash
from veloscope.llm.common import documents, table, written

#: a document is rejected below this score: the classifier takes it to be bad rather than good
REJECT_BELOW = 0.5
#: the mixture is as large as what arrives; a leaf may be taken twice to reach its weight
MIX_PERCENT, MIX_EPOCHS = 100, 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled ones, does not reject."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")
    # written with its documents: rules that read a statistic many times must not compute it as often
    stats = written(quality.statistics(whole, keep=("_doc",)), "statistics")
    return quality.classify(stats, table(spark, sf_dir, "labels")).where(F.col("score") >= REJECT_BELOW).select("_doc.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the SimHash operator (three words, two bits)."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the target mixture, once per epoch that takes them."""
    return mixing.mix(docs, percent=MIX_PERCENT, max_epochs=MIX_EPOCHS)


def training_order_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in their global slots, as binary records."""
    return materialise.records(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage),
          ("mixing", mixing_stage), ("training_order", training_order_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: model fitting, fingerprints and tokenisers are beyond SQL; tests/llm/test_pipeline.py has plain versions
ORACLE_SQL = None
