"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veloscope import constants as K


def c(name_or_col) -> Column:
    return F.col(name_or_col) if isinstance(name_or_col, str) else name_or_col


def micros(ts="timestamp") -> Column:
    """Epoch microseconds of a TIMESTAMP column (the ordering key of all time windows)."""
    return F.unix_micros(c(ts))


def hour_of_day(ts="timestamp") -> Column:
    return F.hour(c(ts))


def day_of_week(ts="timestamp") -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(c(ts))


def is_night(ts="timestamp") -> Column:
    """23:00-04:59 is night."""
    h = F.hour(c(ts))
    return ((h >= 23) | (h < 5)).cast("int")


def is_weekend(ts="timestamp") -> Column:
    return (F.weekday(c(ts)) >= 5).cast("int")


def day_of_month(ts="timestamp") -> Column:
    return F.dayofmonth(c(ts))


def risk_tier(p="fraud_probability") -> Column:
    p = c(p)
    return (F.when(p >= K.TIER_CRITICAL, "CRITICAL")
            .when(p >= K.TIER_HIGH, "HIGH")
            .when(p >= K.TIER_MEDIUM, "MEDIUM")
            .otherwise("LOW"))


def decision(p="fraud_probability") -> Column:
    p = c(p)
    return (F.when(p >= K.DECISION_BLOCK, "block")
            .when(p >= K.DECISION_REVIEW, "review")
            .otherwise("allow"))


def safe_ratio(num, den) -> Column:
    """num / (den + 1e-8), the ratio form used by the behavioural features."""
    return c(num) / (c(den) + F.lit(K.RATIO_EPS))


def mask_id(col, salt: str = "") -> Column:
    """PII mask: hex SHA-256 of the salted value; null stays null."""
    return F.when(c(col).isNotNull(), F.sha2(F.concat(F.lit(salt), c(col).cast("string")), 256))


def mask_ip(col) -> Column:
    """Keep the first two octets of an IPv4 address: a.b.x.x."""
    return F.regexp_replace(c(col), r"^(\d+\.\d+)\.\d+\.\d+$", "$1.x.x")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    r = 6371.0
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dlat = p2 - p1
    dlon = F.radians(c(lon2)) - F.radians(c(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * r) * F.asin(F.sqrt(a))


def round_to(col, places: int) -> Column:
    """Round the binary double half away from zero at ``places`` decimals.

    ``F.round`` rounds the shortest decimal string of the double (0.285 →
    0.29), SQL engines the binary value (0.28499999… → 0.28); scaling first
    makes Spark agree with the latter bit for bit.
    """
    k = float(10 ** places)
    return F.round(c(col).cast("double") * k) / k
