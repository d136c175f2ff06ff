"""Registered scoring, explanation and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators import monitoring as MO
from veloscope.operators import scoring as S
from veloscope.operators.features import feature_matrix
from veloscope.operators.transaction import risk_prior
from veloscope.plans.common import Query, project, registry, sql_select
from veloscope.session import written_once
from veloscope.sources.prediction_log import PREDICTION_LOG_CTE, prediction_log
from veloscope.sources.transactions import SOURCES

TIER_SQL = ("CASE WHEN {p} >= 0.85 THEN 'CRITICAL' WHEN {p} >= 0.6 THEN 'HIGH' "
            "WHEN {p} >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END")

# ---------------------------------------------------------------------------
# H1-H3, H8 batch scoring
# ---------------------------------------------------------------------------
SCORED = {"transaction_id": "l", "fraud_probability": "d", "fraud_label": "l", "risk_tier": "s",
          "decision": "s", "model_version": "s"}


def _score_run(spark, sf_dir):
    txn = SOURCES["events"][0](spark, sf_dir)
    return project(S.score_batch(txn, "score", "rule-v1"), SCORED)


SCORE_SQL = f"""WITH {SOURCES['events'][1]},
s AS (SELECT transaction_id, score AS fraud_probability, CAST(score >= 0.5 AS INTEGER) AS fraud_label,
             {TIER_SQL.format(p='score')} AS risk_tier,
             CASE WHEN score >= {K.DECISION_BLOCK} THEN 'block' WHEN score >= {K.DECISION_REVIEW} THEN 'review'
                  ELSE 'allow' END AS decision, 'rule-v1' AS model_version FROM txn)
SELECT {sql_select(SCORED)} FROM s"""

# ---------------------------------------------------------------------------
# E13 rule prior and H6 weighted ensemble
# ---------------------------------------------------------------------------
PRIOR = {"transaction_id": "l", "risk_prior": "d", "ensemble_score": "d"}


def _prior_sql(source: str) -> str:
    merch = " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.PRIOR_MERCHANT_RATES)
    hi = ", ".join(f"'{c}'" for c in K.PRIOR_HIGH_RISK_COUNTRIES)
    med = ", ".join(f"'{c}'" for c in K.PRIOR_MEDIUM_RISK_COUNTRIES)
    ctry = "country" if source == "orders" else f"'{K.HOME_COUNTRY}'"
    cnp = "CAST(coalesce(NOT card_present, false) AS DOUBLE)" if source == "orders" else "0.0"
    ch, cm, cl = K.PRIOR_COUNTRY_RATES
    wb, wm, wc = K.PRIOR_WEIGHTS
    a = dict(K.PRIOR_ADDONS)
    w1, w2 = K.ENSEMBLE_WEIGHTS
    return f"""WITH {SOURCES[source][1]},
r AS (SELECT *, {K.PRIOR_BASE_RATE * wb} + coalesce(CASE merchant_category {merch} END, {K.PRIOR_MERCHANT_DEFAULT}) * {wm}
             + (CASE WHEN {ctry} IN ({hi}) THEN {ch} WHEN {ctry} IN ({med}) THEN {cm} ELSE {cl} END) * {wc}
             + {cnp} * {a['card_not_present']}
             + CAST(hour("timestamp") >= 23 OR hour("timestamp") < 5 AS DOUBLE) * {a['night']}
             + CAST(coalesce(amount, 0) > 2000 AS DOUBLE) * {a['amount_gt_2000']}
             + CAST(coalesce(amount, 0) > 5000 AS DOUBLE) * {a['amount_gt_5000']} AS raw FROM txn),
p AS (SELECT *, least(greatest(raw / sum(raw) OVER () * ({K.PRIOR_BASE_RATE} * count(*) OVER ()),
                               {K.PRIOR_CLIP[0]}), {K.PRIOR_CLIP[1]}) AS risk_prior FROM r),
e AS (SELECT *, (score * {w1} + risk_prior * {w2}) / ({w1} + {w2}) AS ensemble_score FROM p)
SELECT {sql_select(PRIOR)} FROM e"""


def _prior(source):
    def run(spark, sf_dir):
        df = risk_prior(SOURCES[source][0](spark, sf_dir))
        return project(df.withColumn("ensemble_score", S.weighted_average(["score", "risk_prior"])), PRIOR)
    return Query(f"risk_prior_ensemble_{source}", run, _prior_sql(source), "E13 prior + H6 weighted average")


# ---------------------------------------------------------------------------
# H4/H5 contributions of a linear score over the feature matrix
# ---------------------------------------------------------------------------
EXPLAIN_FEATURES = ("txn_count_1h", "txn_count_24h", "amount_sum_24h", "amount_zscore", "unique_devices_per_user",
                    "has_device_fingerprint", "is_international", "high_risk_country", "merchant_risk_proxy",
                    "is_night", "hour_of_day", "card_not_present", "spend_percentile", "user_txn_count")
BUCKETS = [b[0] for b in K.CONTRIBUTION_BUCKETS]
EXPLAIN = {"transaction_id": "l", **{b: "d" for b in BUCKETS}, "top_features": "s"}


def _explain_run(spark, sf_dir):
    from veloscope.plans.feature_queries import kinds
    # the explainer reads the published feature table (doubles stored to 6 places)
    fm = project(feature_matrix(SOURCES["orders"][0](spark, sf_dir)), kinds("transaction_id", *EXPLAIN_FEATURES))
    fm = written_once(fm, "features")       # the means and the rows come from one computation of the features
    c = S.linear_contributions(fm, EXPLAIN_FEATURES)
    out = c.withColumns(S.contribution_buckets("contributions")).withColumn(
        "top_features", F.array_join(F.transform(S.top_contributions("contributions", 8),
                                                 lambda e: e["feature"]), ","))
    return project(out, EXPLAIN)


def _bucket_of(name: str):
    for b, subs, how in K.CONTRIBUTION_BUCKETS:
        if any(s in name for s in subs):
            return b, how
    return None, None


def _explain_sql():
    from veloscope.plans.feature_queries import features_sql, kinds
    fsql = features_sql("orders", kinds("transaction_id", *[f for f in EXPLAIN_FEATURES]))
    stats = ", ".join(f"avg({f}) AS m_{i}, stddev_samp({f}) AS s_{i}" for i, f in enumerate(EXPLAIN_FEATURES))
    zs = ", ".join(f"CASE WHEN s_{i} > 0 THEN ({f} - m_{i}) / s_{i} ELSE 0.0 END AS z_{i}"
                   for i, f in enumerate(EXPLAIN_FEATURES))
    cols = []
    for b, _subs, how in K.CONTRIBUTION_BUCKETS:
        idx = [i for i, f in enumerate(EXPLAIN_FEATURES) if _bucket_of(f)[0] == b]
        if not idx:
            cols.append(f"CAST(NULL AS DOUBLE) AS {b}")
        elif how == "max":
            cols.append(f"greatest({', '.join(f'abs(z_{i})' for i in idx)}) AS {b}")
        else:
            cols.append(f"abs(z_{idx[-1]}) AS {b}")
    unpiv = " UNION ALL ".join(f"SELECT transaction_id, '{f}' AS feature, z_{i} AS z FROM z"
                               for i, f in enumerate(EXPLAIN_FEATURES))
    return f"""WITH fm AS ({fsql}),
st AS (SELECT {stats} FROM fm),
z AS (SELECT fm.transaction_id, {zs} FROM fm CROSS JOIN st),
u AS ({unpiv}),
t AS (SELECT transaction_id, string_agg(feature, ',' ORDER BY abs(z) DESC, feature) AS top_features
      FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(z) DESC, feature) AS rn FROM u)
      WHERE rn <= 8 GROUP BY transaction_id),
o AS (SELECT z.transaction_id, {', '.join(cols)}, t.top_features FROM z JOIN t USING (transaction_id))
SELECT {sql_select(EXPLAIN)} FROM o"""


# ---------------------------------------------------------------------------
# K monitoring over the prediction log
# ---------------------------------------------------------------------------

def _log_query(name, fn, kinds, body_sql, doc):
    def run(spark, sf_dir):
        return project(fn(prediction_log(spark, sf_dir)), kinds)
    sql = f"WITH {PREDICTION_LOG_CTE},\nq AS ({body_sql})\nSELECT {sql_select(kinds)} FROM q" if body_sql else None
    return Query(name, run, sql, doc)


def _hist_sql(expr: str, bounds, metric: str, src: str = "log") -> str:
    parts = [f"SELECT '{metric}' AS metric, '{MO._le_label(b)}' AS le, CAST(count(*) FILTER (WHERE {expr} <= {float(b)})"
             f" AS DOUBLE) AS value FROM {src}" for b in bounds]
    parts += [f"SELECT '{metric}', '+Inf', CAST(count({expr}) AS DOUBLE) FROM {src}",
              f"SELECT '{metric}', 'count', CAST(count({expr}) AS DOUBLE) FROM {src}",
              f"SELECT '{metric}', 'sum', coalesce(sum({expr}), 0.0) FROM {src}"]
    return " UNION ALL ".join(parts)


HIST = {"metric": "s", "le": "s", "value": "d"}
PCT = {"environment": "s", "n": "l", "p50_ms": "d", "p95_ms": "d", "p99_ms": "d"}
ALERT = {"alert_type": "s", "title": "s", "message": "s", "severity": "s", "source": "s", "details": "s",
         "channel": "s"}


def _batch_sizes(log):
    return log.groupBy(F.date_trunc("minute", "timestamp").alias("minute")).agg(
        F.count(F.lit(1)).cast("double").alias("batch_size"))


def _hourly_rates(log):
    return (log.groupBy(F.date_trunc("hour", "timestamp").alias("window_start"))
               .agg(F.avg(F.col("is_fraud").cast("double")).alias("fraud_rate")))


def _alerts_routed(log):
    rates = _hourly_rates(log)
    fr = MO.fraud_rate_alerts(rates, lookback=24, z_alert=2.0).drop("window_start")
    lat = MO.latency_alert(MO.latency_percentiles(log), sla_ms=K.LATENCY_P99_SLA_MS)
    return MO.route_alerts(fr.unionByName(lat))


def _alerts_sql():
    return f"""WITH {PREDICTION_LOG_CTE},
h AS (SELECT date_trunc('hour', "timestamp") AS window_start, avg(CAST(is_fraud AS DOUBLE)) AS fraud_rate
      FROM log GROUP BY 1),
z AS (SELECT window_start, fraud_rate AS current_rate,
             avg(fraud_rate) OVER w AS baseline_rate, stddev_samp(fraud_rate) OVER w AS sd
      FROM h WINDOW w AS (ORDER BY window_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
z2 AS (SELECT *, CASE WHEN sd > 0 THEN (current_rate - baseline_rate) / sd END AS z_score FROM z),
fr AS (SELECT 'fraud_rate' AS alert_type,
              CASE WHEN current_rate > baseline_rate THEN 'spike' ELSE 'drop' END || ' of the fraud rate' AS title,
              printf('%.3f%% flagged, usually %.3f%% (z %.1f)', current_rate * 100, baseline_rate * 100,
                     z_score) AS message,
              CASE WHEN abs(z_score) > {K.FRAUD_RATE_Z_CRITICAL} THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
              'monitor' AS source,
              '{{"current_rate":' || round(current_rate, 5) || ',"baseline_rate":' || round(baseline_rate, 5)
                || ',"z_score":' || round(z_score, 2) || '}}' AS details
       FROM z2 WHERE abs(z_score) > 2.0),
srt AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS rn, count(*) OVER () AS n FROM log),
p99 AS (SELECT latency_ms AS p99_ms FROM srt WHERE rn = floor(n * 0.99) + 1),
lat AS (SELECT 'latency' AS alert_type, 'Slow responses' AS title,
               printf('p99 %.0f ms, limit {K.LATENCY_P99_SLA_MS:.0f} ms', p99_ms) AS message,
               'WARNING' AS severity, 'monitor' AS source,
               '{{"p99_ms":' || p99_ms || ',"sla_ms":{K.LATENCY_P99_SLA_MS}}}' AS details
        FROM p99 WHERE p99_ms > {K.LATENCY_P99_SLA_MS}),
a AS (SELECT * FROM fr UNION ALL SELECT * FROM lat),
q AS (SELECT a.*, 'slack' AS channel FROM a
      UNION ALL SELECT a.*, 'pagerduty' AS channel FROM a WHERE severity = 'CRITICAL')
SELECT {sql_select(ALERT)} FROM q"""


KPI = {"n": "l", "fraud_rate": "d", "n_false_positive": "l", "n_legit": "l", "revenue_protected": "d",
       "fraud_missed_amount": "d", "false_positive_rate": "d"}


def build():
    return registry(
        Query("score_batch_events", _score_run, SCORE_SQL, "H1-H3, H8: label, tier, decision"),
        _prior("events"), _prior("orders"),
        Query("explain_contributions_orders", _explain_run, _explain_sql(),
              "H4 contribution buckets + H5 top-8 features of a linear score"),
        _log_query("prediction_counts", MO.prediction_counts,
                   {"risk_tier": "s", "environment": "s", "n_predictions": "l"},
                   "SELECT risk_tier, environment, count(*) AS n_predictions FROM log GROUP BY ALL", "K1"),
        _log_query("fraud_prediction_counts", MO.fraud_prediction_counts,
                   {"risk_tier": "s", "n_fraud_predictions": "l"},
                   "SELECT risk_tier, count(*) AS n_fraud_predictions FROM log WHERE fraud_probability >= 0.5 "
                   "GROUP BY ALL", "K2"),
        _log_query("histogram_latency", lambda l: MO.cumulative_histogram(l, "latency_ms", K.LATENCY_BUCKETS_MS,
                                                                        "latency_ms"),
                   HIST, _hist_sql("latency_ms", K.LATENCY_BUCKETS_MS, "latency_ms"), "K3 latency"),
        _log_query("histogram_probability",
                   lambda l: MO.cumulative_histogram(l, "fraud_probability", K.PROBABILITY_BUCKETS, "probability"),
                   HIST, _hist_sql("fraud_probability", K.PROBABILITY_BUCKETS, "probability"), "K3 probability"),
        _log_query("histogram_store_latency",
                   lambda l: MO.cumulative_histogram(l, "store_latency_ms", K.STORE_LATENCY_BUCKETS_MS,
                                                     "store_latency_ms"),
                   HIST, _hist_sql("store_latency_ms", K.STORE_LATENCY_BUCKETS_MS, "store_latency_ms"),
                   "K3 store latency"),
        _log_query("histogram_batch_size",
                   lambda l: MO.cumulative_histogram(_batch_sizes(l), "batch_size", K.BATCH_SIZE_BUCKETS,
                                                     "batch_size"),
                   HIST, "WITH bs AS (SELECT CAST(count(*) AS DOUBLE) AS batch_size FROM log "
                         "GROUP BY date_trunc('minute', \"timestamp\")) "
                   + _hist_sql("batch_size", K.BATCH_SIZE_BUCKETS, "batch_size", "bs"), "K3 batch size"),
        _log_query("store_status_counts", lambda l: MO.status_counts(l, "store_status", "status"),
                   {"status": "s", "n": "l"},
                   "SELECT store_status AS status, count(*) AS n FROM log WHERE store_status IS NOT NULL GROUP BY 1",
                   "K4 hit/miss/error"),
        _log_query("error_type_counts", lambda l: MO.status_counts(l, "error_type", "error_type"),
                   {"error_type": "s", "n": "l"},
                   "SELECT error_type, count(*) AS n FROM log WHERE error_type IS NOT NULL GROUP BY 1", "K4 errors"),
        _log_query("rolling_fraud_rate_1h", MO.rolling_fraud_rate,
                   {"window_start": "t", "window_end": "t", "n_total": "l", "n_flagged": "l", "fraud_rate": "d"},
                   "SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, count(*) AS n_total, "
                   "count(*) FILTER (WHERE fraud_probability >= 0.5) AS n_flagged, "
                   "count(*) FILTER (WHERE fraud_probability >= 0.5) / count(*) AS fraud_rate FROM "
                   "(SELECT *, time_bucket(INTERVAL 5 MINUTE, \"timestamp\") - k * INTERVAL 5 MINUTE AS ws "
                   "FROM log, range(12) t(k)) GROUP BY ws", "K6 sliding 1 h / 5 min"),
        _log_query("latency_percentiles", lambda l: MO.latency_percentiles(l, by=["environment"]), PCT,
                   "SELECT environment, any_value(n) AS n, any_value(med) AS p50_ms, "
                   "min(latency_ms) FILTER (WHERE rn >= floor(n * 0.95) + 1) AS p95_ms, "
                   "min(latency_ms) FILTER (WHERE rn >= floor(n * 0.99) + 1) AS p99_ms FROM "
                   "(SELECT *, row_number() OVER (PARTITION BY environment ORDER BY latency_ms) AS rn, "
                   "count(*) OVER (PARTITION BY environment) AS n, median(latency_ms) OVER (PARTITION BY environment)"
                   " AS med FROM log) GROUP BY environment", "K7"),
        _log_query("error_rate", MO.error_rate, {"n": "l", "n_errors": "l", "error_rate": "d", "breached": "l"},
                   "SELECT n, n_errors, n_errors / n AS error_rate, CAST(n_errors / n > 0.01 AS INTEGER) AS breached "
                   "FROM (SELECT count(*) AS n, count(*) FILTER (WHERE store_status = 'error') AS n_errors FROM log)",
                   "K8"),
        Query("alerts_routed", lambda s, d: project(_alerts_routed(prediction_log(s, d)), ALERT), _alerts_sql(),
              "K11 fraud-rate z alerts (|z|>2 on hourly rates) + K12 latency + K13 routing"),
        _log_query("business_kpis", MO.business_kpis, KPI,
                   "SELECT count(*) AS n, avg(is_fraud) AS fraud_rate, "
                   "count(*) FILTER (WHERE fraud_probability >= 0.5 AND is_fraud <> 1) AS n_false_positive, "
                   "count(*) FILTER (WHERE is_fraud <> 1) AS n_legit, "
                   "coalesce(sum(amount) FILTER (WHERE fraud_probability >= 0.5 AND is_fraud = 1), 0) "
                   "AS revenue_protected, "
                   "coalesce(sum(amount) FILTER (WHERE fraud_probability < 0.5 AND is_fraud = 1), 0) "
                   "AS fraud_missed_amount, "
                   "CASE WHEN count(*) FILTER (WHERE is_fraud <> 1) > 0 THEN "
                   "count(*) FILTER (WHERE fraud_probability >= 0.5 AND is_fraud <> 1) / "
                   "count(*) FILTER (WHERE is_fraud <> 1) ELSE 0 END AS false_positive_rate FROM log", "M12"),
    )
