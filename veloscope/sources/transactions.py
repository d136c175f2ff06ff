"""Transaction tables derived from the driver tables.

Two deterministic mappings give the transaction schema the operators expect
(transaction_id, user_id, amount, currency, merchant_id, merchant_category,
timestamp, is_fraud, optional payment_method / card_present /
device_fingerprint / country / latitude / longitude, plus a ``score`` column
that stands in for a model probability where an operator needs one).

Each mapping exists twice: as a Spark plan (``txn_events``/``txn_orders``)
and as a DuckDB CTE (``TXN_EVENTS_CTE``/``TXN_ORDERS_CTE``) so every oracle
query starts from exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veloscope.functions.columns import round_to


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # the tables hold wall-clock (NTZ) timestamps that the data model reads as UTC
    # instants; every time window and epoch value assumes a UTC session
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as transactions: one user per event, merchant from props.k.

    ``ts`` arrives as TIMESTAMP_NTZ; it is cast once to TIMESTAMP (session TZ
    is UTC, so wall-clock values are unchanged).
    """
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id"),
        F.col("value").alias("amount"),
        F.lit("USD").alias("currency"),
        F.get_json_object("props", "$.k").alias("merchant_id"),
        F.col("event_type").alias("merchant_category"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.col("event_type") == "error").cast("int").alias("is_fraud"),
        round_to(F.col("value") / 500.0, 2).alias("score"),
    )


def txn_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders ⋈ customer ⋈ nation`` as transactions (day-grain timestamps, ties).

    customer and nation are dimension tables (one row per key) and are joined
    on their keys; at scale customer is a shuffle join, nation broadcasts.
    """
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(
        F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("o_orderpriority").alias("merchant_id"),
        F.col("c_mktsegment").alias("merchant_category"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_fraud"),
        F.col("o_orderstatus").alias("payment_method"),
        (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("card_present"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED",
               F.concat(F.lit("dev_"), F.col("o_orderpriority"))).alias("device_fingerprint"),
        F.col("n_name").alias("country"),
        round_to(F.col("o_totalprice") / 500000.0, 4).alias("score"),
    )


def txn_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as transactions keyed by order: transaction_id repeats (B6 duplicates)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_suppkey").alias("user_id"),
        F.col("l_extendedprice").alias("amount"),
        F.lit("USD").alias("currency"),
        F.col("l_partkey").cast("string").alias("merchant_id"),
        F.col("l_returnflag").alias("merchant_category"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"),
        round_to(F.col("l_discount") * 10, 2).alias("score"),
    )


TXN_EVENTS_CTE = """txn AS (
  SELECT event_id AS transaction_id, user_id, value AS amount, 'USD' AS currency,
         json_extract_string(props, '$.k') AS merchant_id,
         event_type AS merchant_category, CAST(ts AS TIMESTAMP) AS "timestamp",
         CAST(event_type = 'error' AS INTEGER) AS is_fraud,
         round(value / 500.0, 2) AS score
  FROM events)"""

TXN_ORDERS_CTE = """txn AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS user_id, o_totalprice AS amount,
         'USD' AS currency, o_orderpriority AS merchant_id, c_mktsegment AS merchant_category,
         CAST(o_orderdate AS TIMESTAMP) AS "timestamp",
         CAST(o_orderstatus = 'F' AS INTEGER) AS is_fraud,
         o_orderstatus AS payment_method,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS card_present,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'dev_' || o_orderpriority END
           AS device_fingerprint,
         n_name AS country,
         round(o_totalprice / 500000.0, 4) AS score
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
              LEFT JOIN nation ON c_nationkey = n_nationkey)"""

TXN_LINEITEM_CTE = """txn AS (
  SELECT l_orderkey AS transaction_id, l_suppkey AS user_id, l_extendedprice AS amount,
         'USD' AS currency, CAST(l_partkey AS VARCHAR) AS merchant_id,
         l_returnflag AS merchant_category, CAST(l_shipdate AS TIMESTAMP) AS "timestamp",
         CAST(l_returnflag = 'R' AS INTEGER) AS is_fraud, round(l_discount * 10, 2) AS score
  FROM lineitem)"""

SOURCES = {"events": (txn_events, TXN_EVENTS_CTE), "orders": (txn_orders, TXN_ORDERS_CTE),
           "lineitem": (txn_lineitem, TXN_LINEITEM_CTE)}
