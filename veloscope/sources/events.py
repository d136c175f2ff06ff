"""Nested events (the API/stream contract) and their flattening."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloscope import constants as K

LOCATION = "struct<country:string,city:string,latitude:double,longitude:double>"


def to_nested(txn: DataFrame, more: tuple = ()) -> DataFrame:
    """Transaction rows → nested events (location struct, null when no country)."""
    cols = set(txn.columns)
    loc = F.when(F.col("country").isNotNull(), F.struct(
        F.col("country").alias("country"), F.lit(None).cast("string").alias("city"),
        (F.col("latitude") if "latitude" in cols else F.lit(None)).cast("double").alias("latitude"),
        (F.col("longitude") if "longitude" in cols else F.lit(None)).cast("double").alias("longitude"),
    )) if "country" in cols else F.lit(None).cast(LOCATION)
    keep = [c for c in ("transaction_id", "user_id", "amount", "currency", "merchant_id", "merchant_category",
                        "payment_method", "timestamp", "card_present", "device_fingerprint", "ip_address")
            if c in cols]
    return txn.select(*keep, loc.alias("location"), *more)


def flatten_event(ev: DataFrame) -> DataFrame:
    """Nested event → flat row; missing location → country US, null lat/lon."""
    cols = set(ev.columns)
    base = [c for c in ev.columns if c != "location"]
    return ev.select(
        *base,
        F.coalesce(F.col("location.country"), F.lit(K.HOME_COUNTRY)).alias("country"),
        F.col("location.latitude").alias("latitude"),
        F.col("location.longitude").alias("longitude"),
    ) if "location" in cols else ev.withColumns({
        "country": F.lit(K.HOME_COUNTRY), "latitude": F.lit(None).cast("double"),
        "longitude": F.lit(None).cast("double")})


def explode_batch(batch: DataFrame, col: str = "transactions") -> DataFrame:
    """A batch request (array of events per row) → one row per event."""
    return batch.select(F.explode(col).alias("_e")).select("_e.*")


def concat_frames(frames: list[DataFrame]) -> DataFrame:
    """Concatenate frames by column name (missing columns become null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sample_exact(df: DataFrame, n: int, seed: int = K.SPLIT_SEED, id_col: str = "transaction_id") -> DataFrame:
    """Exactly min(n, rows) rows, chosen by a seeded hash order (deterministic).

    The order key is the first 60 bits of md5('<id>|<seed>') (reproducible in SQL).
    Rows are numbered in that order by running counts over range partitions, so the sample may be as
    large as the table and is never merged in one task.
    """
    from veloscope.operators.prefix import running_sums
    from veloscope.operators.splits import hash_key
    d = df.withColumns({"_h": hash_key(id_col, seed), "_one": F.lit(1)})
    return running_sums(d, [], "_h", ["_one"], tiebreak=[id_col]).where(F.col("run__one") <= n).select(*df.columns)
