"""Helpers shared by the text operators: inputs, row ids, written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscope.session import remove_at_exit, scratch_path, written_once

#: ASCII lower-casing (other letters stay), and the word class of the tokenisers here
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def written(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """``df`` written once into the shared checkpoint folder and read back: cuts the lineage (lost executors re-read files
    instead of recomputing the plan) and computes the plan exactly once; removed when the driver process ends."""
    return written_once(df, f"llm/{name}", level=level)


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the shared checkpoint folder, for files that tasks write themselves; removed like ``written`` tables."""
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    remove_at_exit(spark, path)
    if path.startswith("/"):
        return f"file://{path}"
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path
