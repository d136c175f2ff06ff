"""Batch sources and sinks for transaction tables (A1-A5).

Format follows the path suffix (.parquet / .csv / .tsv / .json); text formats
are read with an explicit schema (no inference pass over the data) in
PERMISSIVE mode, and timestamps keep microseconds in text form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veloscope import constants as K

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("is_fraud", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Does the path exist on the file system that Spark reads it from?"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _format(path: str) -> str:
    p = path.rstrip("/").lower()
    for suffix, fmt in ((".parquet", "parquet"), (".csv", "csv"), (".tsv", "tsv"), (".json", "json")):
        if p.endswith(suffix):
            return fmt
    raise ValueError(f"unsupported file type: {path}")


def ingest(spark: SparkSession, path: str, schema: T.StructType | None = TRANSACTION_SCHEMA) -> DataFrame:
    """A1/A3: read a table by suffix; missing path or unknown suffix is an error."""
    fmt = _format(path)
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        r = spark.read.option("mode", "PERMISSIVE").option("timestampFormat", TS_FORMAT)
        df = (r.schema(schema) if schema else r).json(path)
    else:
        r = (spark.read.option("header", True).option("mode", "PERMISSIVE")
             .option("timestampFormat", TS_FORMAT).option("sep", "\t" if fmt == "tsv" else ","))
        df = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    if "timestamp" in df.columns and not isinstance(df.schema["timestamp"].dataType, T.TimestampType):
        df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return df


def missing_required(df: DataFrame, required=K.REQUIRED_COLUMNS) -> list[str]:
    """A2: required columns absent from the table (names)."""
    return [c for c in required if c not in df.columns]


def schema_mismatches(df: DataFrame, expected: T.StructType = TRANSACTION_SCHEMA) -> list[str]:
    """A2 extended: columns whose type differs from the expected schema."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f.name for f in expected.fields if f.name in have and have[f.name] != f.dataType]


def validate_schema(df: DataFrame) -> bool:
    return not missing_required(df)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A4: parquet (snappy) / csv / tsv by suffix, optionally partitioned (e.g. by date)."""
    fmt = _format(path)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.option("compression", "snappy").parquet(path)
    elif fmt == "json":
        w.option("timestampFormat", TS_FORMAT).json(path)
    else:
        w.option("header", True).option("timestampFormat", TS_FORMAT) \
         .option("sep", "\t" if fmt == "tsv" else ",").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A5: a (small) report table as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
