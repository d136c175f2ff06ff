"""Streaming sources (A6-A8): JSON events from files or Kafka, parsed with a dead-letter split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("merchant_category", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("card_present", T.BooleanType()),
    T.StructField("device_fingerprint", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("location", T.StructType([
        T.StructField("country", T.StringType()), T.StructField("city", T.StringType()),
        T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])),
])
CORRUPT = "_corrupt_record"
TOPIC_RAW = "transactions.raw"
TOPIC_PREDICTIONS = "fraud.predictions"
TOPIC_ALERTS = "fraud.alerts"


def text_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A6 (file form): one JSON document per line → a ``value`` string column."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str = TOPIC_RAW, starting: str = "latest",
                 max_offsets_per_trigger: int | None = None) -> DataFrame:
    """A6/A7 (Kafka form): needs the spark-sql-kafka connector on the classpath.

    Offsets are tracked in the query checkpoint (at-least-once into
    idempotent sinks); ``maxOffsetsPerTrigger`` bounds each micro-batch.
    """
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", starting))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return r.load().select(F.col("value").cast("string").alias("value"))


def parse_events(raw: DataFrame, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Parse ``value`` (kept); rows that fail keep the text in ``_corrupt_record`` (dead letters)."""
    full = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    parsed = raw.select("value", F.from_json("value", full, {"mode": "PERMISSIVE",
                                                             "columnNameOfCorruptRecord": CORRUPT,
                                                             "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("e"))
    return parsed.select("value", "e.*")


def letter_reason() -> F.Column:
    """Why a message cannot be an event of a timed stream (null: it can)."""
    return F.when(F.col(CORRUPT).isNotNull() | F.col("value").isNull(), "unreadable") \
        .when(F.col("timestamp").isNull(), "no timestamp")


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.where(letter_reason().isNull()).drop(CORRUPT, "value")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """The messages left out by ``good_events``, whole, with the reason."""
    return parsed.where(letter_reason().isNotNull()).select("value", letter_reason().alias("reason"))


def to_event_json(txn: DataFrame, keep: tuple = ()) -> DataFrame:
    """Transactions → the nested event JSON the stream carries (ids as strings), the id and ``keep`` beside it."""
    from veloscope.sources.events import to_nested
    nested = to_nested(txn, keep).withColumns({"transaction_id": F.col("transaction_id").cast("string"),
                                         "user_id": F.col("user_id").cast("string")})
    body = [c for c in nested.columns if c not in keep]
    return nested.select(*keep, F.col("transaction_id").cast("long").alias("_id"),
                         F.to_json(F.struct(*body), {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}).alias("value"))
