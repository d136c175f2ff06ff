"""Transaction, geography and device features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.functions import columns as C
from veloscope.operators.profile import JOIN, OVER, attach, is_first
from veloscope.operators.temporal import US, with_micros

USER = "user_id"


def add_merchant_counts(df: DataFrame, how: str = OVER) -> DataFrame:
    return attach(df, [USER, "merchant_id"], {"_um_count": F.count(F.lit(1))}, how)


def transaction_columns(df: DataFrame, mode: str = "full") -> dict[str, Column]:
    """E1-E5; needs ``_u_mean``/``_u_std`` (user stats) and ``_um_count``."""
    a = F.col("amount")
    return {
        "amount_zscore": F.coalesce(
            (a - F.col("_u_mean")) / (F.coalesce(F.col("_u_std"), F.lit(1.0)) + F.lit(K.RATIO_EPS)),
            F.lit(0.0)),
        "is_round_amount": F.coalesce((F.pmod(a, F.lit(K.ROUND_AMOUNT_MODULUS)) == 0).cast("int"), F.lit(0)),
        "is_large_amount": F.coalesce((a > K.LARGE_AMOUNT).cast("int"), F.lit(0)),
        "is_new_merchant": is_first("_um_count", mode),
        "merchant_risk_proxy": F.coalesce(
            F.col("merchant_category").isin(*K.HIGH_RISK_CATEGORIES).cast("int"), F.lit(0)),
    }


def geo_columns(df: DataFrame, home: str = K.HOME_COUNTRY,
                high_risk: tuple[str, ...] = K.HIGH_RISK_COUNTRIES) -> dict[str, Column]:
    """E6-E9. Absent country → home country, not international; null country → international."""
    if "country" in df.columns:
        ctry = F.col("country")
        out = {
            "country": ctry,
            "is_international": (~ctry.eqNullSafe(home)).cast("int"),
            "high_risk_country": F.coalesce(ctry.isin(*high_risk), F.lit(False)).cast("int"),
        }
    else:
        out = {"country": F.lit(home), "is_international": F.lit(0), "high_risk_country": F.lit(0)}
    if "latitude" in df.columns and "longitude" in df.columns:
        out["latitude"] = F.coalesce(F.col("latitude").cast("double"), F.lit(0.0))
        out["longitude"] = F.coalesce(F.col("longitude").cast("double"), F.lit(0.0))
    else:
        out["latitude"] = F.lit(0.0)
        out["longitude"] = F.lit(0.0)
    return out


def device_columns(df: DataFrame) -> dict[str, Column]:
    """E10-E12; needs ``_u_devices`` when device_fingerprint is present."""
    out = {}
    if "card_present" in df.columns:
        out["card_not_present"] = F.coalesce(~F.col("card_present"), F.lit(False)).cast("int")
    else:
        out["card_not_present"] = F.lit(0)
    if "device_fingerprint" in df.columns:
        out["unique_devices_per_user"] = F.coalesce(F.col("_u_devices"), F.lit(0))
        out["has_device_fingerprint"] = F.col("device_fingerprint").isNotNull().cast("int")
    else:
        out["unique_devices_per_user"] = F.lit(1)
        out["has_device_fingerprint"] = F.lit(0)
    return out


def risk_prior(df: DataFrame, base_rate: float = K.PRIOR_BASE_RATE) -> DataFrame:
    """Rule-based fraud prior, rescaled so that its sum equals base_rate * rows, clipped.

    The rate tables are literal maps (fixed size); the global sum is a
    one-row aggregate cross-joined back (a single row, so it broadcasts).
    """
    merchant = F.create_map(*[x for k, v in K.PRIOR_MERCHANT_RATES for x in (F.lit(k), F.lit(v))])
    m_rate = F.coalesce(F.element_at(merchant, F.col("merchant_category")), F.lit(K.PRIOR_MERCHANT_DEFAULT))
    ctry = F.col("country") if "country" in df.columns else F.lit(K.HOME_COUNTRY)
    hi, med, low = K.PRIOR_COUNTRY_RATES
    c_rate = (F.when(ctry.isin(*K.PRIOR_HIGH_RISK_COUNTRIES), hi)
              .when(ctry.isin(*K.PRIOR_MEDIUM_RISK_COUNTRIES), med).otherwise(low))
    cnp = (F.coalesce(~F.col("card_present"), F.lit(False)) if "card_present" in df.columns
           else F.lit(False)).cast("double")
    night = F.coalesce(C.is_night("timestamp"), F.lit(0)).cast("double")
    a = F.coalesce(F.col("amount"), F.lit(0.0))
    wb, wm, wc = K.PRIOR_WEIGHTS
    add = dict(K.PRIOR_ADDONS)
    raw = (F.lit(base_rate * wb) + m_rate * wm + c_rate * wc
           + cnp * add["card_not_present"] + night * add["night"]
           + (a > 2000).cast("double") * add["amount_gt_2000"]
           + (a > 5000).cast("double") * add["amount_gt_5000"])
    with_raw = df.withColumn("_raw_prior", raw)
    tot = with_raw.agg(F.sum("_raw_prior").alias("_tot"), F.count(F.lit(1)).alias("_n"))
    lo, hi_clip = K.PRIOR_CLIP
    scaled = F.col("_raw_prior") / F.col("_tot") * (F.lit(base_rate) * F.col("_n"))
    return (with_raw.crossJoin(F.broadcast(tot))
            .withColumn("risk_prior", F.least(F.greatest(scaled, F.lit(lo)), F.lit(hi_clip)))
            .drop("_raw_prior", "_tot", "_n"))


def shared_device_count(df: DataFrame) -> DataFrame:
    """M4: distinct users per device (null device → 0), via a (device, user) aggregate + join."""
    if "device_fingerprint" not in df.columns:
        return df.withColumn("shared_device_count", F.lit(0))
    per_dev = (df.where(F.col("device_fingerprint").isNotNull() & F.col(USER).isNotNull())
                 .select("device_fingerprint", USER).distinct()
                 .groupBy("device_fingerprint").agg(F.count(F.lit(1)).alias("shared_device_count")))
    return (df.join(per_dev, "device_fingerprint", "left")
              .withColumn("shared_device_count", F.coalesce("shared_device_count", F.lit(0))))


def merchant_fraud_rate_30d(df: DataFrame, days: int = 30, hot_threshold: int | None = None) -> DataFrame:
    """M5: fraud rate of the merchant over [t - 30 d, t), own row and ties excluded.

    The frame ends one microsecond before t, so equal timestamps are not seen
    (no label leak). Merchants above ``hot_threshold`` rows (default: the
    package threshold) take differences of running totals over (merchant, time) instead of a
    window, so a merchant holding a third of all transactions is spread over all tasks.
    """
    from veloscope.operators.prefix import frame_sums
    from veloscope.operators.skew import DEFAULT_HOT_ROWS, NULL_SALT, null_salt, split_hot
    span = days * 86400 * 1_000_000
    df = with_micros(df).withColumn(NULL_SALT, null_salt("merchant_id", US, "transaction_id"))

    def rate(part):
        w = Window.partitionBy(*part).orderBy(F.col(US)).rangeBetween(-span, -1)
        n = F.count("is_fraud").over(w)
        return F.when(F.col("merchant_id").isNotNull() & F.col(US).isNotNull() & (n > 0),
                      F.sum("is_fraud").over(w) / n).otherwise(F.lit(0.0))

    split = split_hot(df, ["merchant_id"], DEFAULT_HOT_ROWS if hot_threshold is None else hot_threshold)
    plain = split.normal.withColumn("merchant_fraud_rate_30d", rate(["merchant_id", NULL_SALT])).drop(NULL_SALT)
    if split.hot is None:
        return plain
    hot = split.hot.drop(NULL_SALT)
    nulls = hot.where(F.col(US).isNull()).withColumn("merchant_fraud_rate_30d", F.lit(0.0))
    rows = hot.where(F.col(US).isNotNull()).withColumns({
        "_y": F.coalesce(F.col("is_fraud"), F.lit(0)).cast("long"), "_l": F.col("is_fraud").isNotNull().cast("long")})
    b = frame_sums(rows, "merchant_id", US, {"_f": (-span - 1, -1)}, ["_y", "_l"]).withColumn(
        "merchant_fraud_rate_30d", F.when(F.col("_f__l") > 0, F.col("_f__y") / F.col("_f__l")).otherwise(F.lit(0.0)))
    return plain.unionByName(b.drop("_y", "_l", "_f__y", "_f__l")).unionByName(nulls)


def distance_from_home(df: DataFrame, id_col: str = "transaction_id", hot_threshold: int | None = None
                       ) -> DataFrame:
    """M6: km from the user's mean location over earlier rows (first row / no location / no user → 0).

    Hot users get the mean of earlier rows from running sums (sum and
    count up to the row, minus the row itself) instead of a per-user window.
    """
    if "latitude" not in df.columns or "longitude" not in df.columns:
        return df.withColumn("distance_from_home", F.lit(0.0))
    from veloscope.operators.prefix import running_sums
    from veloscope.operators.skew import DEFAULT_HOT_ROWS, split_hot
    df = with_micros(df)
    nobody = df.where(F.col(USER).isNull()).withColumn("distance_from_home", F.lit(0.0))
    split = split_hot(df.where(F.col(USER).isNotNull()), [USER], DEFAULT_HOT_ROWS if hot_threshold is None else hot_threshold)
    w = (Window.partitionBy(USER).orderBy(F.col(US).asc_nulls_last(), F.col(id_col))
         .rowsBetween(Window.unboundedPreceding, -1))
    d = C.haversine_km(F.avg("latitude").over(w), F.avg("longitude").over(w), "latitude", "longitude")
    plain = split.normal.withColumn("distance_from_home", F.coalesce(d, F.lit(0.0))).unionByName(nobody)
    if split.hot is None:
        return plain
    parts = {"_la": F.coalesce(F.col("latitude"), F.lit(0.0)), "_lac": F.col("latitude").isNotNull().cast("long"),
             "_lo": F.coalesce(F.col("longitude"), F.lit(0.0)), "_loc": F.col("longitude").isNotNull().cast("long")}
    h = split.hot.withColumns(parts)
    r = running_sums(h, [USER], US, list(parts), tiebreak=[id_col])
    prev = {k: F.col(f"run_{k}") - F.col(k) for k in parts}
    mlat = F.when(prev["_lac"] > 0, prev["_la"] / prev["_lac"])
    mlon = F.when(prev["_loc"] > 0, prev["_lo"] / prev["_loc"])
    hot = r.withColumn("distance_from_home",
                       F.coalesce(C.haversine_km(mlat, mlon, "latitude", "longitude"), F.lit(0.0))) \
           .drop(*parts, *[f"run_{k}" for k in parts], *[f"tot_{k}" for k in parts])
    return plain.unionByName(hot)


def device_age(df: DataFrame, how: str = JOIN) -> DataFrame:
    """M7: days since the first use of (user, device); new_device = first use.
    (First use per key is a partial aggregate joined back: skew-safe.)"""
    if "device_fingerprint" not in df.columns:
        return df.withColumns({"device_age_days": F.lit(0.0), "new_device": F.lit(0)})
    df = with_micros(df)
    first = attach(df, [USER, "device_fingerprint"], {"_dev_first": F.min(US)}, how)
    age = (F.col(US) - F.col("_dev_first")) / 86_400_000_000.0
    return first.withColumns({
        "device_age_days": F.coalesce(age, F.lit(0.0)),
        "new_device": F.coalesce((F.col(US) == F.col("_dev_first")).cast("int"), F.lit(0)),
    }).drop("_dev_first")


def first_use_flags(df: DataFrame, id_col: str = "transaction_id", how: str = JOIN) -> DataFrame:
    """D7b / E4b point-in-time variants: 1 on the user's first transaction in a category /
    with a merchant (only earlier rows matter, so no future information leaks).

    The first (time, id) pair per key is a partial aggregate joined back, so a
    hot (user, category) key is never sorted in one task.
    """
    df = with_micros(df)
    out = df
    for key, name in (("merchant_category", "is_first_category_pit"), ("merchant_id", "is_first_merchant_pit")):
        first = F.min(F.struct(F.col(US), F.col(id_col)))
        out = attach(out, [USER, key], {f"_first_{key}": first}, how)
        me = F.struct(F.col(US), F.col(id_col))
        out = out.withColumn(name, F.coalesce((me == F.col(f"_first_{key}")).cast("int"), F.lit(0))) \
                 .drop(f"_first_{key}")
    return out


def force_positive_count(df: DataFrame, target: int, label: str = "is_fraud", id_col: str = "transaction_id",
                         seed: int = K.SPLIT_SEED) -> DataFrame:
    """Exactly ``target`` positives: the surplus positives (or the missing count of
    negatives) with the smallest seeded hash flip. Positions come from running
    counts, so neither class sits in one task."""
    from veloscope.operators.splits import class_positions
    cnt = df.agg(F.sum(F.col(label)).alias("_npos"))
    p = class_positions(df, label, id_col, seed).crossJoin(F.broadcast(cnt))
    surplus = F.col("_npos") - F.lit(target)
    flip = (((F.col(label) == 1) & (surplus > 0) & (F.col("_pos") <= surplus))
            | ((F.col(label) == 0) & (surplus < 0) & (F.col("_pos") <= -surplus)))
    return p.withColumn(label, F.when(flip, 1 - F.col(label)).otherwise(F.col(label))) \
            .drop("_pos", "_n_class", "_npos")


def oversample_minority(df: DataFrame, ratio: float = K.OVERSAMPLE_RATIO, label: str = "is_fraud") -> DataFrame:
    """Replicate minority rows until positives / all >= ratio (whole copies, each row
    the same number of times; neighbour synthesis is not done). Adds ``copy`` (0 = original)."""
    c = df.agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    # p*k / (p*k + q) >= r  →  k = ceil(r*q / ((1-r)*p))
    k = F.greatest(F.lit(1), F.ceil(F.lit(ratio) * F.col("_q") / ((1 - ratio) * F.col("_p")))).cast("int")
    j = df.crossJoin(F.broadcast(c.withColumn("_k", F.when(F.col("_p") > 0, k).otherwise(1))))
    reps = F.when(F.col(label) == 1, F.sequence(F.lit(0), F.col("_k") - 1)).otherwise(F.array(F.lit(0)))
    return j.withColumn("copy", F.explode(reps)).drop("_p", "_q", "_k")


def ip_risk(df: DataFrame, risk_table: DataFrame, ip_col: str = "ip_address") -> DataFrame:
    """ip_risk_score / vpn_detected from a user-given (ip_address, ip_risk_score,
    vpn_detected) table; the optimizer picks the join."""
    out = df.join(risk_table, ip_col, "left")
    return out.withColumns({"ip_risk_score": F.coalesce("ip_risk_score", F.lit(0.0)),
                            "vpn_detected": F.coalesce(F.col("vpn_detected").cast("int"), F.lit(0))})


def mask_pii(df: DataFrame, salt: str = "") -> DataFrame:
    """M8: user_id → salted SHA-256, ip_address → first two octets."""
    out = {"user_id": C.mask_id("user_id", salt)}
    if "ip_address" in df.columns:
        out["ip_address"] = C.mask_ip("ip_address")
    return df.withColumns(out)
