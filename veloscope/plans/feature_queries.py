"""Registered feature queries (C, D, E, F0, M1-M7) and their DuckDB oracles."""

from __future__ import annotations

from veloscope import constants as K
from veloscope.operators import behavioral as B
from veloscope.operators import features as FE
from veloscope.operators import temporal as T
from veloscope.operators import transaction as X
from veloscope.plans.common import Query, project, registry, sql_select, typed
from veloscope.sources.transactions import SOURCES

HOUR_US = 3600 * 1_000_000

KINDS = {
    "transaction_id": "l", "user_id": "l", "merchant_id": "s", "timestamp": "t", "is_fraud": "l",
    "amount": "d", "currency": "s", "merchant_category": "s",
    **{n: "l" for n in FE.CALENDAR},
    **{f"txn_count_{h}h": "l" for h in K.VELOCITY_WINDOWS_HOURS},
    **{f"amount_sum_{h}h": "d" for h in K.VELOCITY_WINDOWS_HOURS},
    **{f"amount_max_{h}h": "d" for h in K.VELOCITY_WINDOWS_HOURS},
    **{f"unique_merchants_{h}h": "l" for h in K.VELOCITY_WINDOWS_HOURS},
    "days_since_first_txn": "d", "seconds_since_last_txn": "d",
    "amount_vs_user_avg": "d", "amount_vs_user_median": "d", "user_night_txn_ratio": "d",
    "user_total_spend": "d", "user_txn_count": "l", "category_frequency_ratio": "d",
    "is_new_category": "l", "spend_percentile": "d", "avg_daily_spend": "d",
    "amount_zscore": "d", "is_round_amount": "l", "is_large_amount": "l", "is_new_merchant": "l",
    "merchant_risk_proxy": "l",
    "country": "s", "is_international": "l", "high_risk_country": "l", "latitude": "d", "longitude": "d",
    "card_not_present": "l", "unique_devices_per_user": "l", "has_device_fingerprint": "l",
    "intl_txn_ratio": "d", "preferred_payment_match": "l", "shared_device_count": "l",
    "merchant_fraud_rate_30d": "d", "distance_from_home": "d", "device_age_days": "d", "new_device": "l",
    "unique_countries_1h": "l", "unique_countries_24h": "l",
}


def kinds(*names: str) -> dict[str, str]:
    return {n: KINDS[n] for n in names}


# ---------------------------------------------------------------------------
# DuckDB side: one CTE chain computes every feature column for a source
# ---------------------------------------------------------------------------

def _present(source: str) -> set[str]:
    return {"events": set(), "orders": {"payment_method", "card_present", "device_fingerprint", "country"}}[source]


def _profiles_sql(mode: str, devs: str) -> tuple[str, str, str]:
    """CTEs u, uc, um, their joins, and which count says "new"."""
    stats = f"""avg(amount){{o}} AS m, stddev_samp(amount){{o}} AS s, median(amount){{o}} AS med,
             count(transaction_id){{o}} AS n, avg(is_night){{o}} AS night, sum(amount){{o}} AS spend,
             count(DISTINCT CAST("timestamp" AS DATE)){{o}} AS days,
             sum(amount) FILTER (WHERE "timestamp" IS NOT NULL){{o}} AS dspend{devs}"""
    if mode == "full":
        return (f"""u AS (SELECT user_id, {stats.format(o="")}
      FROM b WHERE user_id IS NOT NULL GROUP BY user_id),
uc AS (SELECT user_id, merchant_category, count(*) AS n FROM b GROUP BY ALL),
um AS (SELECT user_id, merchant_id, count(*) AS n FROM b GROUP BY ALL)""",
                """LEFT JOIN u ON b.user_id = u.user_id
         LEFT JOIN uc ON b.user_id = uc.user_id AND b.merchant_category = uc.merchant_category
         LEFT JOIN um ON b.user_id = um.user_id AND b.merchant_id = um.merchant_id""", "1")
    before = "ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    per = lambda c: (f"(SELECT transaction_id, count(*) OVER (PARTITION BY user_id, {c} {before}) AS n FROM b "  # noqa: E731
                     f"WHERE user_id IS NOT NULL AND {c} IS NOT NULL)")
    return (f"""u AS (SELECT transaction_id, {stats.format(o=" OVER h")}
      FROM b WHERE user_id IS NOT NULL WINDOW h AS (PARTITION BY user_id {before})),
uc AS {per("merchant_category")},
um AS {per("merchant_id")}""", """LEFT JOIN u ON b.transaction_id = u.transaction_id
         LEFT JOIN uc ON b.transaction_id = uc.transaction_id LEFT JOIN um ON b.transaction_id = um.transaction_id""", "0")


def features_sql(source: str, cols: dict[str, str], mode: str = "full", cte: str | None = None) -> str:
    present = _present(source)
    cte = cte or SOURCES[source][1]
    wins = ",\n  ".join(
        f"w{h} AS (PARTITION BY b.user_id ORDER BY us RANGE BETWEEN {h * HOUR_US - 1} PRECEDING AND CURRENT ROW)"
        for h in K.VELOCITY_WINDOWS_HOURS)
    vel = ",\n    ".join(
        f"count(*) OVER w{h} AS txn_count_{h}h, coalesce(sum(amount) OVER w{h}, 0) AS amount_sum_{h}h, "
        f"coalesce(max(amount) OVER w{h}, 0) AS amount_max_{h}h, "
        f"count(DISTINCT b.merchant_id) OVER w{h} AS unique_merchants_{h}h"
        for h in K.VELOCITY_WINDOWS_HOURS)
    cats = ", ".join(f"'{x}'" for x in K.HIGH_RISK_CATEGORIES)
    risky = ", ".join(f"'{x}'" for x in K.HIGH_RISK_COUNTRIES)
    if "country" in present:
        geo = (f"country, CAST(country IS DISTINCT FROM '{K.HOME_COUNTRY}' AS INTEGER) AS is_international, "
               f"CAST(coalesce(country IN ({risky}), false) AS INTEGER) AS high_risk_country")
    else:
        geo = f"'{K.HOME_COUNTRY}' AS country, 0 AS is_international, 0 AS high_risk_country"
    cnp = ("CAST(coalesce(NOT card_present, false) AS INTEGER)" if "card_present" in present else "0")
    if "device_fingerprint" in present:
        dev = ("coalesce(u.devs, 0) AS unique_devices_per_user, "
               "CAST(device_fingerprint IS NOT NULL AS INTEGER) AS has_device_fingerprint")
        devs = ", count(DISTINCT device_fingerprint){o} AS devs"
    else:
        dev = "1 AS unique_devices_per_user, 0 AS has_device_fingerprint"
        devs = ""
    profiles, joins, once = _profiles_sql(mode, devs)
    return f"""WITH {cte},
b AS (SELECT *, epoch_us("timestamp") AS us,
             CAST(coalesce(hour("timestamp") >= 23 OR hour("timestamp") < 5, false) AS INTEGER) AS is_night FROM txn),
{profiles},
f AS (
  SELECT b.transaction_id, b.user_id, b.merchant_id, b."timestamp", b.is_fraud,
    b.amount, b.currency, b.merchant_category,
    hour("timestamp") AS hour_of_day, isodow("timestamp") - 1 AS day_of_week, b.is_night,
    CAST(isodow("timestamp") >= 6 AS INTEGER) AS is_weekend, day("timestamp") AS day_of_month,
    {vel},
    (us - min(us) OVER (PARTITION BY b.user_id)) / 86400000000.0 AS days_since_first_txn,
    coalesce((us - lag(us) OVER (PARTITION BY b.user_id ORDER BY us, b.transaction_id)) / 1e6, -1)
      AS seconds_since_last_txn,
    coalesce(amount / (u.m + 1e-8), 0) AS amount_vs_user_avg,
    coalesce(amount / (u.med + 1e-8), 0) AS amount_vs_user_median,
    coalesce(u.night, 0) AS user_night_txn_ratio, coalesce(u.spend, 0) AS user_total_spend,
    coalesce(u.n, 0) AS user_txn_count,
    coalesce(uc.n / (u.n + 1e-8), 0) AS category_frequency_ratio,
    coalesce(CAST(uc.n = {once} AS INTEGER), 0) AS is_new_category,
    CASE WHEN count(*) OVER (PARTITION BY b.user_id) <= 1 THEN 0.5
         ELSE len(list_filter(list(amount) OVER (PARTITION BY b.user_id ORDER BY us, b.transaction_id
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                              lambda x: x <= amount))
              / row_number() OVER (PARTITION BY b.user_id ORDER BY us, b.transaction_id) END
      AS spend_percentile,
    coalesce(CASE WHEN u.days > 0 THEN coalesce(u.dspend, 0) / u.days END, 0) AS avg_daily_spend,
    coalesce((amount - u.m) / (coalesce(u.s, 1) + 1e-8), 0) AS amount_zscore,
    CAST(amount % 100 = 0 AS INTEGER) AS is_round_amount,
    CAST(amount > {K.LARGE_AMOUNT} AS INTEGER) AS is_large_amount,
    coalesce(CAST(um.n = {once} AS INTEGER), 0) AS is_new_merchant,
    CAST(coalesce(b.merchant_category IN ({cats}), false) AS INTEGER) AS merchant_risk_proxy,
    {geo}, 0.0 AS latitude, 0.0 AS longitude,
    {cnp} AS card_not_present, {dev}
  FROM b {joins}
  WINDOW {wins}
)
SELECT {sql_select(cols)}
FROM f"""


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def _features_query(name: str, source: str, groups, cols: dict[str, str], doc: str,
                    hot_threshold: int | None = None, mode: str = "full") -> Query:
    """``hot_threshold=None``: the driver's check data has no hot user; the
    default detection threshold is used (the bucketed shape has its own tests)."""
    def run(spark, sf_dir):
        txn = SOURCES[source][0](spark, sf_dir)
        kw = {} if hot_threshold is None else {"hot_threshold": hot_threshold}
        # typed output fused into the final projection of the feature plan
        out = FE.feature_matrix(txn, groups=groups, finish=lambda n, c: typed(n, cols[n], c) if n in cols else c,
                                mode=mode, **kw)
        return out.select(*cols)
    return Query(name, run, features_sql(source, cols, mode), doc)


IDS = ("transaction_id", "user_id")
VEL = lambda h: (f"txn_count_{h}h", f"amount_sum_{h}h", f"amount_max_{h}h", f"unique_merchants_{h}h")


def _m_query(name, source, fn, out_cols, sql_body, doc):
    def run(spark, sf_dir):
        return project(fn(SOURCES[source][0](spark, sf_dir)), kinds(*IDS, *out_cols))
    sql = f"WITH {SOURCES[source][1]},\nb AS (SELECT *, epoch_us(\"timestamp\") AS us FROM txn),\n" \
          f"f AS ({sql_body})\nSELECT {sql_select(kinds(*IDS, *out_cols))} FROM f"
    return Query(name, run, sql, doc)


def build() -> dict[str, Query]:
    all_cols = kinds(*FE.ID_COLUMNS, *FE.feature_names())
    qs = [
        _features_query("feature_matrix_events", "events", FE.ALL_GROUPS, all_cols,
                        "F0/F6: 48-column feature matrix over events"),
        _features_query("feature_matrix_orders", "orders", FE.ALL_GROUPS, all_cols,
                        "F0/F6 over orders: ties, country, device, card columns present"),
        _features_query("calendar_features", "events", ("calendar",), kinds(*IDS, *FE.CALENDAR),
                        "C1-C5"),
        _features_query("recency_features", "events", ("recency",), kinds(*IDS, *FE.RECENCY),
                        "C10-C11"),
        _features_query("recency_features_ties", "orders", ("recency",), kinds(*IDS, *FE.RECENCY),
                        "C10-C11 with tied day-grain timestamps"),
        _features_query("behavioral_features", "events", ("behavioral",), kinds(*IDS, *FE.BEHAVIORAL),
                        "D1-D9"),
        _features_query("behavioral_features_orders", "orders", ("behavioral",),
                        kinds(*IDS, *FE.BEHAVIORAL), "D1-D9 with ties"),
        _features_query("transaction_features", "events", ("transaction",),
                        kinds(*IDS, *FE.TRANSACTION), "E1-E5"),
        _features_query("geo_device_features", "orders", ("geo", "device"),
                        kinds(*IDS, *FE.GEO, *FE.DEVICE), "E6-E12"),
        _features_query("features_bucketed_hot_path", "events", FE.ALL_GROUPS, all_cols,
                        "F0 with every user routed to the bucketed hot-user shape", hot_threshold=0),
        _features_query("features_bucketed_hot_path_orders", "orders", FE.ALL_GROUPS, all_cols,
                        "F0 over orders, bucketed hot-user shape", hot_threshold=0),
    ]
    for src, note in (("events", ""), ("orders", " with ties, devices and countries")):
        qs.append(_features_query(f"feature_matrix_point_in_time_{src}", src, FE.ALL_GROUPS, all_cols,
                                  f"F0 with D1, D3-D7, D9, E1, E5, E11 over earlier rows only{note}", mode="point_in_time"))
    for h in K.VELOCITY_WINDOWS_HOURS:
        qs.append(_features_query(f"velocity_{h}h", "events", ("velocity",), kinds(*IDS, *VEL(h)),
                                  f"C6-C9 for the {h} h window"))
    qs.append(_features_query("velocity_24h_ties", "orders", ("velocity",), kinds(*IDS, *VEL(24)),
                              "C6-C9 24 h with day-grain ties"))
    for src in ("events", "orders"):
        def run_d8(spark, sf_dir, src=src):
            out = B.spend_percentile_distributed(SOURCES[src][0](spark, sf_dir), block=8)
            return project(out, kinds(*IDS, "spend_percentile"))
        qs.append(Query(f"spend_percentile_distributed_{src}", run_d8,
                        features_sql(src, kinds(*IDS, "spend_percentile")),
                        "D8 on the hot-user shape with 8-row blocks (several Fenwick levels per user)"))
    qs += [
        _m_query("intl_txn_ratio", "orders", lambda d: B.intl_txn_ratio(d), ["intl_txn_ratio"],
                 "SELECT *, avg(CAST(country IS DISTINCT FROM 'US' AS INTEGER)) OVER (PARTITION BY user_id)"
                 " AS intl_txn_ratio FROM b", "M2"),
        _m_query("preferred_payment_match", "orders", B.preferred_payment_match,
                 ["preferred_payment_match"],
                 "SELECT b.*, coalesce(CAST(b.payment_method = p.pref AS INTEGER), 0) AS preferred_payment_match "
                 "FROM b LEFT JOIN (SELECT user_id, arg_min(payment_method, (-n, payment_method)) AS pref FROM "
                 "(SELECT user_id, payment_method, count(*) AS n FROM b GROUP BY ALL) GROUP BY user_id) p "
                 "ON b.user_id = p.user_id", "M3"),
        _m_query("shared_device_count", "orders", X.shared_device_count, ["shared_device_count"],
                 "SELECT b.*, coalesce(d.c, 0) AS shared_device_count FROM b LEFT JOIN "
                 "(SELECT device_fingerprint, count(DISTINCT user_id) AS c FROM b GROUP BY 1) d "
                 "ON b.device_fingerprint = d.device_fingerprint", "M4"),
        _m_query("merchant_fraud_rate_30d", "events", X.merchant_fraud_rate_30d, ["merchant_fraud_rate_30d"],
                 "SELECT *, coalesce(sum(is_fraud) OVER w / nullif(count(is_fraud) OVER w, 0), 0) "
                 "AS merchant_fraud_rate_30d FROM b WINDOW w AS (PARTITION BY merchant_id ORDER BY us "
                 f"RANGE BETWEEN {30 * 24 * HOUR_US} PRECEDING AND 1 PRECEDING)", "M5"),
        _m_query("merchant_fraud_rate_30d_hot_path", "events", lambda d: X.merchant_fraud_rate_30d(d, hot_threshold=0),
                 ["merchant_fraud_rate_30d"],
                 "SELECT *, coalesce(sum(is_fraud) OVER w / nullif(count(is_fraud) OVER w, 0), 0) "
                 "AS merchant_fraud_rate_30d FROM b WINDOW w AS (PARTITION BY merchant_id ORDER BY us "
                 f"RANGE BETWEEN {30 * 24 * HOUR_US} PRECEDING AND 1 PRECEDING)", "M5 with every merchant hot"),
        _m_query("device_age", "orders", X.device_age, ["device_age_days", "new_device"],
                 "SELECT *, coalesce(CASE WHEN device_fingerprint IS NOT NULL THEN "
                 "(us - min(us) OVER w) / 86400000000.0 END, 0) AS device_age_days, "
                 "coalesce(CASE WHEN device_fingerprint IS NOT NULL THEN CAST(us = min(us) OVER w AS INTEGER) END, 0)"
                 " AS new_device FROM b "
                 "WINDOW w AS (PARTITION BY user_id, device_fingerprint)", "M7"),
        _m_query("unique_countries", "orders",
                 lambda d: T.distinct_velocity(d, (1, 24), (("unique_countries", "country"),)),
                 ["unique_countries_1h", "unique_countries_24h"],
                 "SELECT *, count(DISTINCT country) OVER w1 AS unique_countries_1h, "
                 "count(DISTINCT country) OVER w24 AS unique_countries_24h FROM b WINDOW "
                 f"w1 AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {HOUR_US - 1} PRECEDING AND CURRENT ROW), "
                 f"w24 AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {24 * HOUR_US - 1} PRECEDING AND CURRENT ROW)",
                 "M1"),
    ]
    return registry(*qs)
