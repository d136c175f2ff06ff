"""Registered drift queries (J1-J10, K9) on events: first half of the month vs second half.

Features: amount, score, hour_of_day, is_fraud, ``amount_shift`` (amount in
the reference half, 1.5 * amount + 10 in the current half: a real shift) and
``rare`` (amount above 480 only: too few current values, so it is skipped).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators import drift as D
from veloscope.operators import monitoring as MO
from veloscope.plans.common import Query, project, registry, sql_select
from veloscope.sources.transactions import SOURCES

FEATS = ["amount", "score", "hour_of_day", "is_fraud", "amount_shift", "rare"]
PER = {"feature": "s", "psi": "d", "psi_band": "s", "ks_statistic": "d", "ks_pvalue": "d", "js_distance": "d",
       "drifted": "l", "n_current": "l"}
SUMMARY = {"total_features_checked": "l", "drifted_feature_count": "l", "stable_feature_count": "l",
           "max_psi": "d", "max_ks_stat": "d", "drift_rate": "d", "overall_drifted": "l"}
PROFILE = {"feature": "s", "n_ref": "l", "mean": "d", "std": "d", "min": "d", "max": "d",
           **{f"p{int(q * 100)}": "d" for q in K.DRIFT_PERCENTILES}}
ALERT = {"alert_type": "s", "title": "s", "message": "s", "severity": "s", "source": "s", "details": "s"}


def _halves(spark, sf_dir):
    txn = SOURCES["events"][0](spark, sf_dir).withColumns({
        "hour_of_day": F.hour("timestamp"), "rare": F.when(F.col("amount") > 480, F.col("amount"))})
    return D.sides_by_time(txn).withColumn(
        "amount_shift", F.when(F.col("side") == 0, F.col("amount")).otherwise(F.col("amount") * 1.5 + 10))


def _report(spark, sf_dir):
    return D.drift_of(D.long_sides(_halves(spark, sf_dir), FEATS), FEATS)


def _profile_run(spark, sf_dir):
    p = D.reference_profile(D.long_format(_halves(spark, sf_dir).where("side = 0"), FEATS))
    p = p.select("*", *[F.col("percentiles")[i].alias(f"p{int(q * 100)}") for i, q in enumerate(K.DRIFT_PERCENTILES)])
    return project(p, PROFILE)


BASE_SQL = f"""WITH {SOURCES['events'][1]},
t AS (SELECT *, hour("timestamp") AS hour_of_day, CASE WHEN amount > 480 THEN amount END AS rare FROM txn),
mm AS (SELECT make_timestamp((epoch_us(min("timestamp")) + epoch_us(max("timestamp"))) // 2) AS mid FROM t),
ref AS (SELECT t.*, amount AS amount_shift FROM t, mm WHERE "timestamp" < mid),
cur AS (SELECT t.*, amount * 1.5 + 10 AS amount_shift FROM t, mm WHERE "timestamp" >= mid),
rl AS (UNPIVOT (SELECT {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATS)} FROM ref)
       ON {', '.join(FEATS)} INTO NAME feature VALUE x),
cl AS (UNPIVOT (SELECT {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATS)} FROM cur)
       ON {', '.join(FEATS)} INTO NAME feature VALUE x),
prof AS (SELECT feature, count(*) AS n_ref, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max,
                quantile_cont(x, {list(K.DRIFT_PERCENTILES)}) AS pct,
                CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
         FROM rl GROUP BY feature),
pe AS (SELECT *, [{', '.join(f'lo + {float(i)} * ((hi - lo) / {K.DRIFT_BINS})' for i in range(K.DRIFT_BINS))}, hi] AS edges
       FROM prof)"""


def _bins(src):
    return (f"SELECT feature, len(list_filter(edges[2:{K.DRIFT_BINS}], lambda e: x >= e)) AS bin, count(*) AS h "
            f"FROM {src} JOIN pe USING (feature) WHERE x >= edges[1] AND x <= edges[{K.DRIFT_BINS + 1}] GROUP BY ALL")


REPORT_SQL = BASE_SQL + f""",
g AS (SELECT pe.feature, pe.edges, b.bin, coalesce(r.h, 0) AS h_ref, coalesce(c.h, 0) AS h_cur
      FROM pe CROSS JOIN range({K.DRIFT_BINS}) b(bin)
      LEFT JOIN ({_bins('rl')}) r ON r.feature = pe.feature AND r.bin = b.bin
      LEFT JOIN ({_bins('cl')}) c ON c.feature = pe.feature AND c.bin = b.bin),
g2 AS (SELECT *, sum(h_ref) OVER (PARTITION BY feature) AS sr, sum(h_cur) OVER (PARTITION BY feature) AS sc,
              edges[bin + 2] - edges[bin + 1] AS w FROM g),
g3 AS (SELECT *, h_ref / (sr + 1e-8) + 1e-8 AS pr, h_cur / (sc + 1e-8) + 1e-8 AS pc,
              h_ref / (sr * w) + 1e-8 AS dr, h_cur / (sc * w) + 1e-8 AS dc FROM g2),
g4 AS (SELECT *, dr / sum(dr) OVER (PARTITION BY feature) AS jp, dc / sum(dc) OVER (PARTITION BY feature) AS jq FROM g3),
ps AS (SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi_raw, any_value(sc) AS sc,
              sqrt(sum(jp * ln(jp / ((jp + jq) / 2)) + jq * ln(jq / ((jp + jq) / 2))) / 2) AS js_raw
       FROM g4 GROUP BY feature),
u AS (SELECT feature, x, sum(a) AS a, sum(b) AS b FROM
        (SELECT feature, x, 1 AS a, 0 AS b FROM rl UNION ALL SELECT feature, x, 0, 1 FROM cl) GROUP BY ALL),
ku AS (SELECT *, sum(a) OVER (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING) AS ra,
              sum(b) OVER (PARTITION BY feature ORDER BY x ROWS UNBOUNDED PRECEDING) AS rb,
              sum(a) OVER (PARTITION BY feature) AS ta, sum(b) OVER (PARTITION BY feature) AS tb FROM u),
ks AS (SELECT feature, max(abs(ra / ta - rb / tb)) AS ks_raw, any_value(ta) AS n_ref, any_value(tb) AS n_cur
       FROM ku GROUP BY feature),
kp AS (SELECT *, ks_raw * sqrt(n_ref * n_cur / (n_ref + n_cur)) AS lam FROM ks),
kp2 AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101),
              lambda k: pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam))), 0.0), 1.0) END AS p_raw FROM kp),
per AS (SELECT ps.feature, round(psi_raw, 4) AS psi,
               CASE WHEN psi_raw < {K.PSI_MODERATE} THEN 'stable' WHEN psi_raw <= {K.PSI_THRESHOLD} THEN 'moderate'
                    ELSE 'significant' END AS psi_band,
               round(ks_raw, 4) AS ks_statistic, round(p_raw, 4) AS ks_pvalue,
               round(CASE WHEN sc > 0 THEN js_raw END, 4) AS js_distance,
               CAST(psi_raw > {K.PSI_THRESHOLD} OR p_raw < {K.KS_PVALUE_THRESHOLD} AS INTEGER) AS drifted,
               n_cur AS n_current
        FROM ps JOIN kp2 USING (feature) WHERE n_cur >= {K.DRIFT_MIN_CURRENT}),
summ AS (SELECT {len(FEATS)} AS total_features_checked, count(*) FILTER (WHERE drifted = 1) AS drifted_feature_count,
                count(*) FILTER (WHERE drifted = 0) AS stable_feature_count,
                coalesce(max(psi), 0.0) AS max_psi, coalesce(max(ks_statistic), 0.0) AS max_ks_stat,
                count(*) FILTER (WHERE drifted = 1) / greatest({len(FEATS)}, 1) AS drift_rate,
                CAST(count(*) FILTER (WHERE drifted = 1) > 0 AS INTEGER) AS overall_drifted FROM per)"""


def _alert_sql():
    return REPORT_SQL + f""",
nm AS (SELECT list_sort(list(feature)) AS names FROM per WHERE drifted = 1),
al AS (SELECT 'drift' AS alert_type, 'Inputs moved away from their reference' AS title,
              printf('%d moved, largest PSI %.3f (limit %.2f): ', drifted_feature_count, max_psi,
                     {K.PSI_THRESHOLD}) || array_to_string(names[1:5], ', ')
                || CASE WHEN len(names) > 5 THEN ' ...' ELSE '' END AS message,
              CASE WHEN max_psi > {K.DRIFT_CRITICAL_PSI} THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
              'drift_detector' AS source,
              '{{"drifted_features":[' || array_to_string(list_transform(names, lambda s: '"' || s || '"'), ',')
                || '],"max_psi":' || round(max_psi, 4) || ',"threshold":{K.PSI_THRESHOLD}}}' AS details
       FROM summ, nm WHERE drifted_feature_count > 0)
SELECT {sql_select(ALERT)} FROM al"""


def _alert_run(spark, sf_dir):
    per, summary = _report(spark, sf_dir)
    return project(MO.drift_alert(summary, per), ALERT)


EXACT = {"feature": "s", "ks_statistic": "d", "n_ref": "l", "n_cur": "l", "ks_pvalue": "d"}


def _exact_run(spark, sf_dir):
    """J5 per user: do the amounts of the second half of the period look like those of the first? Samples of some dozen values."""
    txn = SOURCES["events"][0](spark, sf_dir)
    mid = txn.agg(((F.min(F.unix_micros("timestamp")) + F.max(F.unix_micros("timestamp"))) / 2).alias("mid"))
    side = (F.unix_micros("timestamp") > F.col("mid")).cast("int")
    long = txn.crossJoin(F.broadcast(mid)).where(F.col("amount").isNotNull() & side.isNotNull()).select(
        F.concat(F.lit("amount of user "), F.col("user_id").cast("string")).alias("feature"), F.col("amount").alias("x"), side.alias("side"))
    return project(D.ks_test(D.value_table(long)), EXACT)


EXACT_SQL = f"""WITH RECURSIVE {SOURCES['events'][1]},
s AS (SELECT 'amount of user ' || CAST(user_id AS VARCHAR) AS feature, amount AS x, CAST(epoch_us("timestamp") > (SELECT
        (min(epoch_us("timestamp")) + max(epoch_us("timestamp"))) / 2 FROM txn) AS INTEGER) AS side FROM txn WHERE amount IS NOT NULL AND user_id IS NOT NULL),
v AS (SELECT feature, x, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM s GROUP BY 1, 2),
r AS (SELECT feature, sum(a) OVER w AS ra, sum(b) OVER w AS rb, sum(a) OVER (PARTITION BY feature) AS n, sum(b) OVER (PARTITION BY feature) AS m
      FROM v WINDOW w AS (PARTITION BY feature ORDER BY x)),
g AS (SELECT feature, CAST(any_value(n) AS BIGINT) AS n, CAST(any_value(m) AS BIGINT) AS m, CAST(max(abs(ra * m - rb * n)) AS BIGINT) AS gap
      FROM r WHERE n > 0 AND m > 0 GROUP BY 1),
path AS (       -- u[i + 1]: a path to (i, k - i) has stayed inside
  SELECT feature, n, m, gap, 0 AS k, [CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for i in range(0, n + 1)] AS u FROM g
  UNION ALL
  SELECT feature, n, m, gap, k + 1,
         [CASE WHEN k + 1 - i < 0 OR k + 1 - i > m OR abs(i * m - (k + 1 - i) * n) >= gap THEN 0.0::DOUBLE
               ELSE (i * coalesce(u[i], 0.0) + (k + 1 - i) * u[i + 1]) / (k + 1) END for i in range(0, n + 1)]
  FROM path WHERE k < n + m),
q AS (SELECT feature, gap / (n * m) AS ks_statistic, n AS n_ref, m AS n_cur,
             CASE WHEN gap <= 0 THEN 1.0 ELSE least(greatest(1 - u[n + 1], 0), 1) END AS ks_pvalue FROM path WHERE k = n + m)
SELECT {sql_select(EXACT)} FROM q"""


def build():
    return registry(
        Query("drift_profile_events", _profile_run,
              BASE_SQL + f"\nSELECT {sql_select(PROFILE)} FROM (SELECT *, "
              + ", ".join(f"pct[{i + 1}] AS p{int(q * 100)}" for i, q in enumerate(K.DRIFT_PERCENTILES))
              + " FROM prof)", "J1 reference profile"),
        Query("drift_features_events", lambda s, d: project(_report(s, d)[0], PER),
              REPORT_SQL + f"\nSELECT {sql_select(PER)} FROM per", "J2-J7, J9 per-feature drift"),
        Query("drift_summary_events", lambda s, d: project(_report(s, d)[1], SUMMARY),
              REPORT_SQL + f"\nSELECT {sql_select(SUMMARY)} FROM summ", "J8 drift summary"),
        Query("drift_alert_events", _alert_run, _alert_sql(), "K9 drift alert"),
        Query("ks_exact_users_events", _exact_run, EXACT_SQL, "J5 exact two-sample p-values of small samples, a test per user"),
    )
