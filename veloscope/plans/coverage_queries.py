"""Registered queries on dirty and derived rows: nulls, absent columns, unreadable times, string ids, coordinates, addresses.

The driver tables are clean; here their rows get faults by rule (nulls by id, garbled times, string ids), so that the
branches of the operators which clean rows never reach are checked as well.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.functions import columns as C
from veloscope.operators import behavioral as B
from veloscope.operators import drift as DR
from veloscope.operators import evaluation as EV
from veloscope.operators import features as FE
from veloscope.operators import learn as L
from veloscope.operators import networks as NW
from veloscope.operators import quality as Q
from veloscope.operators import registry as RG
from veloscope.operators import scoring as S
from veloscope.operators import splits as SP
from veloscope.operators import store as ST
from veloscope.operators import temporal as T
from veloscope.operators import transaction as X
from veloscope.plans.common import Query, project, registry, sql_select
from veloscope.plans.eval_queries import _kinds, eval_sql
from veloscope.plans.feature_queries import features_sql
from veloscope.plans.model_queries import HASH_SQL, REG_CTE, registry_table
from veloscope.plans.quality_queries import REPORT, report_sql
from veloscope.plans.scoring_queries import TIER_SQL
from veloscope.session import scratch_path
from veloscope.sources import events as SE
from veloscope.sources import files as FI
from veloscope.sources.transactions import SOURCES, TXN_EVENTS_CTE


def dirty(spark, sf_dir) -> DataFrame:
    """events with 30 % null users, null amounts, labels and times, one user owning a third of the rows, skewed scores."""
    t = SOURCES["events"][0](spark, sf_dir)
    i = F.col("transaction_id")
    return t.withColumns({
        "user_id": F.when(i % 10 < 3, None).when(i % 3 == 0, 1).otherwise(F.col("user_id")),
        "amount": F.when(i % 17 != 4, F.col("amount")),
        "is_fraud": F.when(i % 13 != 6, F.col("is_fraud")),
        "timestamp": F.when(i % 19 != 7, F.col("timestamp")),
        "merchant_id": F.when(i % 23 != 8, F.col("merchant_id")),
        "score": F.pow(F.col("score") / 10.0, 4),
    })


DIRTY = f"""raw AS (SELECT * FROM ({TXN_EVENTS_CTE[len('txn AS ('):-1]}) x),
txn AS (SELECT transaction_id, CASE WHEN transaction_id % 10 < 3 THEN NULL WHEN transaction_id % 3 = 0 THEN 1 ELSE user_id END AS user_id,
  CASE WHEN transaction_id % 17 <> 4 THEN amount END AS amount, currency,
  CASE WHEN transaction_id % 23 <> 8 THEN merchant_id END AS merchant_id, merchant_category,
  CASE WHEN transaction_id % 19 <> 7 THEN "timestamp" END AS "timestamp",
  CASE WHEN transaction_id % 13 <> 6 THEN is_fraud END AS is_fraud, pow(score / 10.0, 4) AS score FROM raw)"""


def _dirty_report(spark, sf_dir):
    return project(Q.validation_report(dirty(spark, sf_dir)), REPORT)


def _dirty_report_sql():
    return report_sql("events").replace(TXN_EVENTS_CTE, DIRTY)


FLAGS = {"variant": "s", "passed": "l", "n_rows": "l", "errors": "s"}


def _variants(spark, sf_dir) -> dict:
    t = SOURCES["events"][0](spark, sf_dir)
    garbled = t.withColumn("timestamp", F.when(F.col("transaction_id") % 9 == 2, F.lit("soon")).otherwise(F.col("timestamp").cast("string")))
    return {"as it is": t, "no merchant": t.drop("merchant_id"), "no label": t.drop("is_fraud"), "no rows": t.where("transaction_id < 0"),
            "text times": garbled}


def _flags_run(spark, sf_dir):
    rows = [Q.validation_report(v).select(F.lit(k).alias("variant"), "passed", "n_rows", "errors") for k, v in _variants(spark, sf_dir).items()]
    return project(reduce(DataFrame.unionByName, rows), FLAGS)


FLAGS_SQL = f"""WITH {TXN_EVENTS_CTE}, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE transaction_id % 9 = 2) AS bad FROM txn),
q AS (SELECT 'as it is' AS variant, 1 AS passed, n AS n_rows, '' AS errors FROM n
  UNION ALL SELECT 'no merchant', 0, n, 'columns absent: merchant_id' FROM n
  UNION ALL SELECT 'no label', 0, n, 'columns absent: is_fraud (the label)' FROM n
  UNION ALL SELECT 'no rows', 0, 0, 'no rows' FROM n
  UNION ALL SELECT 'text times', 0, n, printf('timestamp: %d unreadable', bad) FROM n)
SELECT {sql_select(FLAGS)} FROM q"""

CHECKS = {"variant": "s", "schema_ok": "l", "types_differ": "s", "valid": "l", "refused": "s"}


def _checks_run(spark, sf_dir):
    """What the plan-time and quick checks say of each variant of the table."""
    out = []
    for k, v in _variants(spark, sf_dir).items():
        try:
            Q.check_input(v)
            refused = ""
        except ValueError as e:
            refused = str(e)
        out.append(Q.validation_report(v, fail_fast=True).select(
            F.lit(k).alias("variant"), F.lit(int(FI.validate_schema(v))).alias("schema_ok"),
            F.lit(", ".join(FI.schema_mismatches(v))).alias("types_differ"), F.col("passed").alias("valid"),
            F.lit(refused).alias("refused")))
    return project(reduce(DataFrame.unionByName, out), CHECKS)


CHECKS_SQL = f"""WITH {TXN_EVENTS_CTE}, n AS (SELECT count(*) AS n FROM txn),
q AS (SELECT 'as it is' AS variant, 1 AS schema_ok, '' AS types_differ, 1 AS valid, '' AS refused FROM n
  UNION ALL SELECT 'no merchant', 0, '', 0, 'columns absent: merchant_id' FROM n
  UNION ALL SELECT 'no label', 1, '', 0, 'columns absent: is_fraud' FROM n
  UNION ALL SELECT 'no rows', 1, '', 0, 'the table has no rows' FROM n
  UNION ALL SELECT 'text times', 1, 'timestamp', 0, '' FROM n)
SELECT {sql_select(CHECKS)} FROM q"""

SPLIT = {"transaction_id": "l", "split": "s"}
SPLIT_SQL = f"""WITH {DIRTY},
h AS (SELECT *, {HASH_SQL.format(seed=K.SPLIT_SEED)} AS hk FROM txn),
r AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY hk, transaction_id) AS pos, count(*) OVER (PARTITION BY is_fraud) AS n FROM h),
s AS (SELECT *, ceil(n * {K.TEST_SIZE}) AS nt FROM r),
q AS (SELECT transaction_id, CASE WHEN is_fraud IS NULL THEN 'unlabelled' WHEN pos <= nt THEN 'test'
  WHEN pos <= nt + ceil((n - nt) * {(K.VAL_SIZE / (1 - K.TEST_SIZE))!r}) THEN 'val' ELSE 'train' END AS split FROM s)
SELECT {sql_select(SPLIT)} FROM q"""


def _string_eval_run(spark, sf_dir):
    t = dirty(spark, sf_dir).withColumn("transaction_id", F.concat(F.lit("t"), F.col("transaction_id").cast("string")))
    return project(EV.evaluate(t, prefix="test"), _kinds([]))


def _string_eval_sql():
    rel = DIRTY.replace("txn AS (SELECT transaction_id,", "txn AS (SELECT 't' || CAST(transaction_id AS VARCHAR) AS transaction_id,")
    return eval_sql(None, [], rel=rel)


def _report_json_run(spark, sf_dir):
    """I16, A5: the metric row as a JSON report, written and read back."""
    path = scratch_path(spark, f"report-{uuid.uuid4().hex[:8]}.json")
    FI.write_report(EV.evaluate(SOURCES["events"][0](spark, sf_dir), prefix="test"), path)
    back = FI.read_report(spark, path)
    kinds = _kinds([])
    return project(back.select(*[F.col(k) if k in back.columns else F.lit(None).alias(k) for k in kinds]), kinds)


VEL = {"transaction_id": "l", **{f"{p}_24h": k for p, k in (("txn_count", "l"), ("amount_sum", "d"), ("amount_max", "d"), ("unique_merchants", "l"))}}


def _velocity_run(hot):
    def run(spark, sf_dir):
        t = dirty(spark, sf_dir)
        out = T.plain_velocity(t, (24,)) if not hot else T.bucketed_velocity_recency(t, (24,))
        return project(out, VEL)
    return run


VEL_SQL = f"""WITH {DIRTY},
q AS (SELECT t.transaction_id, count(s.transaction_id) AS txn_count_24h, coalesce(sum(s.amount), 0) AS amount_sum_24h,
             coalesce(max(s.amount), 0) AS amount_max_24h, count(DISTINCT s.merchant_id) AS unique_merchants_24h
      FROM txn t LEFT JOIN txn s ON s.user_id = t.user_id AND s."timestamp" <= t."timestamp" AND s."timestamp" > t."timestamp" - INTERVAL 24 HOUR
      GROUP BY t.transaction_id)
SELECT {sql_select(VEL)} FROM q"""

PIT = {"transaction_id": "l", **{n: "l" if n in ("user_txn_count", "is_new_category") else "d" for n in FE.BEHAVIORAL if n != "spend_percentile"},
       "amount_zscore": "d", "is_new_merchant": "l"}


def _pit_run(spark, sf_dir):
    return project(FE.feature_matrix(dirty(spark, sf_dir), groups=("behavioral", "transaction"), mode="point_in_time", hot_threshold=None), PIT)


PCT = {"transaction_id": "l", "spend_percentile": "d"}


def _pct_run(distributed):
    def run(spark, sf_dir):
        f = B.spend_percentile_distributed if distributed else B.spend_percentile
        return project(f(dirty(spark, sf_dir)), PCT)
    return run


PCT_SQL = f"""WITH {DIRTY},
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" NULLS LAST, transaction_id) AS pos,
             count(*) OVER (PARTITION BY user_id) AS n FROM txn),
q AS (SELECT t.transaction_id, CASE WHEN t.user_id IS NULL OR t.n <= 1 THEN 0.5
         ELSE count(s.transaction_id) FILTER (WHERE s.amount <= t.amount) / t.pos END AS spend_percentile
      FROM o t LEFT JOIN o s ON s.user_id = t.user_id AND s.pos <= t.pos GROUP BY t.transaction_id, t.user_id, t.n, t.pos)
SELECT {sql_select(PCT)} FROM q"""

ASOF = {"transaction_id": "l", "prev_amount": "d", "counter_60m": "l"}


def _asof_run(hot):
    def run(spark, sf_dir):
        t = dirty(spark, sf_dir)
        a = ST.asof_profile(t, ("amount",), hot_threshold=hot).select("transaction_id", "prev_amount")
        c = ST.session_counters(t, (60,), hot_threshold=hot).select("transaction_id", "counter_60m")
        return project(a.join(c, "transaction_id"), ASOF)
    return run


ASOF_SQL = f"""WITH {DIRTY},
o AS (SELECT *, epoch_us("timestamp") AS us, row_number() OVER w AS pos, lag("timestamp") OVER w AS prev,
             last_value(amount IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_amount
      FROM txn WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp" NULLS LAST, transaction_id)),
n AS (SELECT *, CASE WHEN pos = 1 OR us - epoch_us(prev) >= 3600000000 THEN pos END AS start FROM o),
q AS (SELECT transaction_id, prev_amount, pos - max(start) OVER (PARTITION BY user_id ORDER BY pos) + 1 AS counter_60m FROM n
      UNION ALL SELECT transaction_id, NULL, 1 FROM txn WHERE user_id IS NULL)
SELECT {sql_select(ASOF)} FROM q"""

UPS = {"user_id": "l", "last_txn_amount": "d", "last_txn_country": "s", "updated_at": "t"}


def _upsert_run(cuts):
    """G4 with null fields: one batch and two batches give one answer."""
    def run(spark, sf_dir):
        t = dirty(spark, sf_dir).where("timestamp IS NOT NULL").withColumn(
            "country", F.when(F.col("transaction_id") % 4 == 1, F.concat(F.lit("C"), (F.col("transaction_id") % 5).cast("string"))))
        store = spark.createDataFrame([], "user_id long, last_txn_amount double, last_txn_timestamp timestamp, "
                                          "last_txn_country string, updated_at timestamp")
        for part in ([t] if cuts == 1 else DR.split_by_time(t)):
            store = ST.upsert(store, ST.user_updates(part))
        return project(store, UPS)
    return run


UPS_SQL = f"""WITH {DIRTY},
d AS (SELECT *, CASE WHEN transaction_id % 4 = 1 THEN 'C' || CAST(transaction_id % 5 AS VARCHAR) END AS country FROM txn
      WHERE "timestamp" IS NOT NULL AND user_id IS NOT NULL),
q AS (SELECT user_id, arg_max(amount, ("timestamp", transaction_id)) FILTER (WHERE amount IS NOT NULL) AS last_txn_amount,
             arg_max(country, ("timestamp", transaction_id)) FILTER (WHERE country IS NOT NULL) AS last_txn_country,
             max("timestamp") AS updated_at FROM d GROUP BY user_id)
SELECT {sql_select(UPS)} FROM q"""

CAT = {"transaction_id": "l", "amount": "d", "side": "s"}


def _concat_run(spark, sf_dir):
    """Batch requests (an array of events per user and day) exploded, two tables concatenated."""
    t = SOURCES["events"][0](spark, sf_dir)
    day = F.to_date("timestamp")
    batches = t.withColumn("day", day).groupBy("user_id", "day").agg(F.collect_list(F.struct("transaction_id", "amount")).alias("transactions"))
    one = SE.explode_batch(batches.where("user_id % 2 = 0")).withColumn("side", F.lit("batch"))
    return project(SE.concat_frames([one, t.where("user_id % 2 = 1").select("transaction_id", "amount")]).fillna("row", ["side"]), CAT)


CAT_SQL = f"""WITH {TXN_EVENTS_CTE}, q AS (SELECT transaction_id, amount, CASE WHEN user_id % 2 = 0 THEN 'batch' ELSE 'row' END AS side FROM txn)
SELECT {sql_select(CAT)} FROM q"""

RES = {"transaction_id": "l", "fraud_probability": "d", "risk_tier": "s", "day": "s"}


def _result_run(spark, sf_dir):
    """H9, A4: the result table of a batch, written by day and read back."""
    t = SOURCES["events"][0](spark, sf_dir).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    path = scratch_path(spark, f"results-{uuid.uuid4().hex[:8]}.parquet")
    FI.write_table(S.score_batch(t, "score", keep=("day",)), path, partition_by=["day"])
    return project(FI.ingest(spark, path).withColumn("day", F.date_format("day", "yyyy-MM-dd")), RES)


RES_SQL = f"""WITH {TXN_EVENTS_CTE}, q AS (SELECT transaction_id, score AS fraud_probability, {TIER_SQL.format(p='score')} AS risk_tier,
  strftime("timestamp", '%Y-%m-%d') AS day FROM txn) SELECT {sql_select(RES)} FROM q"""

TRAIL = {"side": "s", "n": "l", "mean_amount": "d", "first": "t"}
TRAIL_ASOF = "2024-01-20 12:00:00"


def _trailing_run(spark, sf_dir):
    ref, cur = DR.trailing_reference(SOURCES["events"][0](spark, sf_dir), TRAIL_ASOF, days=10, check_hours=24)
    rows = [d.agg(F.lit(k).alias("side"), F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean_amount"), F.min("timestamp").alias("first"))
            for k, d in (("reference", ref), ("current", cur))]
    return project(rows[0].unionByName(rows[1]), TRAIL)


TRAIL_SQL = f"""WITH {TXN_EVENTS_CTE}, a AS (SELECT TIMESTAMP '{TRAIL_ASOF}' AS t),
q AS (SELECT 'reference' AS side, count(*) AS n, avg(amount) AS mean_amount, min("timestamp") AS "first" FROM txn, a
      WHERE "timestamp" >= t - INTERVAL 10 DAY AND "timestamp" < t - INTERVAL 24 HOUR
      UNION ALL SELECT 'current', count(*), avg(amount), min("timestamp") FROM txn, a
      WHERE "timestamp" >= t - INTERVAL 24 HOUR AND "timestamp" < t)
SELECT {sql_select(TRAIL)} FROM q"""

HOME = {"transaction_id": "l", "distance_from_home": "d"}


def _home_run(hot):
    def run(spark, sf_dir):
        t = SOURCES["events"][0](spark, sf_dir)
        m = F.col("merchant_id").cast("int")
        t = t.withColumns({"latitude": F.when(F.col("transaction_id") % 6 != 1, (m % 90) - 40.0),
                           "longitude": F.when(F.col("transaction_id") % 6 != 1, (m * 7 % 300) - 150.0)})
        return project(X.distance_from_home(t, hot_threshold=hot), HOME)
    return run


HOME_SQL = f"""WITH {TXN_EVENTS_CTE},
g AS (SELECT *, CASE WHEN transaction_id % 6 <> 1 THEN CAST(merchant_id AS INT) % 90 - 40.0 END AS la,
             CASE WHEN transaction_id % 6 <> 1 THEN CAST(merchant_id AS INT) * 7 % 300 - 150.0 END AS lo FROM txn),
h AS (SELECT *, avg(la) OVER w AS hla, avg(lo) OVER w AS hlo FROM g
      WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp" NULLS LAST, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT transaction_id, coalesce({{haversine}}, 0) AS distance_from_home FROM h)
SELECT {sql_select(HOME)} FROM q"""
HAVERSINE = ("2 * 6371.0 * asin(sqrt(pow(sin(radians(la - hla) / 2), 2) "
             "+ cos(radians(hla)) * cos(radians(la)) * pow(sin(radians(lo - hlo) / 2), 2)))")

IPR = {"transaction_id": "l", "ip_risk_score": "d", "vpn_detected": "l", "masked": "s"}


def _ip(user):
    return F.concat(F.lit("10."), (user % 200).cast("string"), F.lit(".7."), (user % 13).cast("string"))


def _ip_run(spark, sf_dir):
    t = SOURCES["events"][0](spark, sf_dir).withColumn("ip_address", _ip(F.col("user_id")))
    risk = t.where("user_id % 3 = 0").groupBy("ip_address").agg(F.avg("is_fraud").alias("ip_risk_score"), (F.count(F.lit(1)) % 2 == 0).alias("vpn_detected"))
    return project(X.ip_risk(t, risk).withColumn("masked", C.mask_ip("ip_address")), IPR)


IPR_SQL = f"""WITH {TXN_EVENTS_CTE},
t AS (SELECT *, '10.' || CAST(user_id % 200 AS VARCHAR) || '.7.' || CAST(user_id % 13 AS VARCHAR) AS ip FROM txn),
r AS (SELECT ip, avg(is_fraud) AS s, CAST(count(*) % 2 = 0 AS INTEGER) AS v FROM t WHERE user_id % 3 = 0 GROUP BY ip),
q AS (SELECT transaction_id, coalesce(s, 0) AS ip_risk_score, coalesce(v, 0) AS vpn_detected, {{mask}} AS masked FROM t LEFT JOIN r USING (ip))
SELECT {sql_select(IPR)} FROM q"""

NET = {"transaction_id": "l", "ip_risk_score": "d", "vpn_detected": "l", "ip_network": "s"}


def _net_run(spark, sf_dir):
    """Nested networks of four lengths a family, with the fraud rate of the users behind them as score."""
    u = F.col("user_id")
    a, b, c = (x.cast("string") for x in (u % 200, u % 7, u % 13))
    h = F.lower(F.hex(u % 200))
    v6 = u % 4 == 0
    t = SOURCES["events"][0](spark, sf_dir).withColumn("ip_address", F.when(v6, F.concat(F.lit("2001:db8:"), h, F.lit("::"), F.lower(F.hex(u % 13))))
                                                       .otherwise(F.concat_ws(".", F.lit("10"), a, b, c)))
    net = lambda when, six, four: F.when(when, F.when(v6, six).otherwise(four))
    nets = F.array(net(u % 2 == 0, F.lit("2001:db8::/32"), F.lit("10.0.0.0/8")),
                   net(u % 3 == 0, F.concat(F.lit("2001:db8:"), h, F.lit("::/48")), F.concat(F.lit("10."), a, F.lit(".0.0/16"))),
                   net(u % 5 == 0, F.concat(F.lit("2001:db8:"), h, F.lit("::/125")), F.concat(F.lit("10."), a, F.lit("."), b, F.lit(".0/29"))),
                   net(u % 11 == 0, F.col("ip_address"), F.concat(F.col("ip_address"), F.lit("/32"))))
    networks = t.select(F.explode(nets).alias("network"), "is_fraud").where("network IS NOT NULL").groupBy("network") \
        .agg(F.avg("is_fraud").alias("ip_risk_score"), (F.count(F.lit(1)) % 2 == 0).alias("vpn_detected"))
    return project(NW.network_risk(t, networks), NET)


NET_SQL = f"""WITH {TXN_EVENTS_CTE},
t AS (SELECT transaction_id, is_fraud, user_id AS u, user_id % 4 = 0 AS v6, lower(to_hex(user_id % 200)) AS h,
             CASE WHEN user_id % 4 = 0 THEN 536939960::HUGEINT * CAST('79228162514264337593543950336' AS HUGEINT)
                  + (user_id % 200)::HUGEINT * CAST('1208925819614629174706176' AS HUGEINT) + user_id % 13
                  ELSE 167772160 + (user_id % 200) * 65536 + (user_id % 7) * 256 + user_id % 13 END AS pos FROM txn),
n4 AS (SELECT is_fraud, v6, unnest([
    CASE WHEN u % 2 = 0 THEN {{{{'s': CASE WHEN v6 THEN '2001:db8::/32' ELSE '10.0.0.0/8' END, 'w': CASE WHEN v6 THEN 96 ELSE 24 END, 'pos': pos}}}} END,
    CASE WHEN u % 3 = 0 THEN {{{{'s': CASE WHEN v6 THEN '2001:db8:' || h || '::/48' ELSE '10.' || (u % 200) || '.0.0/16' END, 'w': CASE WHEN v6 THEN 80 ELSE 16 END, 'pos': pos}}}} END,
    CASE WHEN u % 5 = 0 THEN {{{{'s': CASE WHEN v6 THEN '2001:db8:' || h || '::/125' ELSE '10.' || (u % 200) || '.' || (u % 7) || '.0/29' END, 'w': 3,
        'pos': pos - u % 13}}}} END,
    CASE WHEN u % 11 = 0 THEN {{{{'s': CASE WHEN v6 THEN '2001:db8:' || h || '::' || lower(to_hex(u % 13)) ELSE '10.' || (u % 200) || '.' || (u % 7) || '.' || (u % 13) || '/32' END,
        'w': 0, 'pos': pos}}}} END]) AS x FROM t),
nets AS (SELECT v6, x.s AS network, x.w AS w, x.pos // (2::HUGEINT ** x.w)::HUGEINT AS top, avg(is_fraud) AS score, CAST(count(*) % 2 = 0 AS INTEGER) AS vpn
         FROM n4 WHERE x IS NOT NULL GROUP BY ALL),
q AS (SELECT t.transaction_id, coalesce(arg_min(score, w), 0) AS ip_risk_score, coalesce(arg_min(vpn, w), 0) AS vpn_detected, arg_min(network, w) AS ip_network
      FROM t LEFT JOIN nets ON nets.v6 = t.v6 AND t.pos >= top * (2::HUGEINT ** w)::HUGEINT AND t.pos < (top + 1) * (2::HUGEINT ** w)::HUGEINT GROUP BY 1)
SELECT {sql_select(NET)} FROM q""".replace("{{", "{").replace("}}", "}")

TOPK = {"feature": "s", "importance": "d"}


def _topk_run(spark, sf_dir):
    t = SOURCES["events"][0](spark, sf_dir)
    n = t.agg(F.count(F.lit(1)).alias("n"))
    imp = t.groupBy(F.col("merchant_id").alias("feature")).agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n)) \
        .select("feature", (F.col("c") / F.col("n")).alias("importance"))
    return project(L.top_k_features(imp, k=20, min_importance=0.005), TOPK)


TOPK_SQL = f"""WITH {TXN_EVENTS_CTE}, i AS (SELECT merchant_id AS feature, count(*) / (SELECT count(*) FROM txn) AS importance FROM txn GROUP BY 1),
q AS (SELECT * FROM i WHERE importance >= 0.005 ORDER BY importance DESC, feature LIMIT 20) SELECT {sql_select(TOPK)} FROM q"""

CON = {"transaction_id": "l", "accepted": "l", "contract_errors": "s"}


def _contract_run(spark, sf_dir):
    """B12, B13 with both outcomes: ``contract_split`` on the dirty events, categories mapped to the contract's."""
    from veloscope.plans.stream_queries import category
    t = dirty(spark, sf_dir).withColumns({"merchant_category": category(), "payment_method": F.lit("credit_card")})
    ok, bad = Q.contract_split(SE.flatten_event(SE.to_nested(t)))
    return project(ok.select("transaction_id", F.lit(1).alias("accepted"), F.lit("").alias("contract_errors")).unionByName(
        bad.select("transaction_id", F.lit(0).alias("accepted"), F.array_join("contract_errors", "; ").alias("contract_errors"))), CON)


CON_SQL = f"""WITH {DIRTY},
e AS (SELECT transaction_id, concat_ws('; ', CASE WHEN user_id IS NULL THEN 'user_id length' END,
    CASE WHEN amount IS NULL OR amount <= 0 OR amount > {K.MAX_AMOUNT} THEN 'amount range' END,
    CASE WHEN merchant_id IS NULL THEN 'merchant_id length' END, CASE WHEN merchant_category = 'error' THEN 'merchant_category enum' END)
    AS contract_errors FROM txn),
q AS (SELECT *, CAST(contract_errors = '' AS INTEGER) AS accepted FROM e) SELECT {sql_select(CON)} FROM q"""

REG = {"name": "s", "version": "l", "stage": "s"}


def _reg(name, fn, body, doc, kinds=None):
    kinds = kinds or REG
    return Query(name, lambda s, d: project(fn(registry_table(s, d)), kinds), f"WITH {REG_CTE},\nq AS ({body})\nSELECT {sql_select(kinds)} FROM q", doc)


def build():
    return registry(
        Query("quality_report_dirty_events", _dirty_report, _dirty_report_sql(), "B3-B10 on rows with nulls in every column"),
        Query("quality_flags_events", _flags_run, FLAGS_SQL, "B1-B3, B7: absent columns, no rows, unreadable times"),
        Query("input_checks_events", _checks_run, CHECKS_SQL, "A2, B1, B2, B11, B15"),
        Query("contract_split_events", _contract_run, CON_SQL, "B12-B13 with accepted and rejected events"),
        Query("stratified_split_null_labels", lambda s, d: project(SP.stratified_split(dirty(s, d)), SPLIT), SPLIT_SQL, "L1 keeps unlabelled rows"),
        Query("evaluation_string_ids", _string_eval_run, _string_eval_sql(), "I1-I15 with string ids, null labels, skewed scores"),
        Query("report_json_events", _report_json_run, eval_sql("events", []), "A5, I16: report as JSON, written and read back"),
        Query("profiles_point_in_time_dirty", _pit_run, features_sql("events", PIT, "point_in_time", DIRTY),
              "D1, D3-D7, D9, E1, E5 over earlier rows: null users, times, amounts; one user with a third of the rows"),
        Query("velocity_24h_dirty", _velocity_run(False), VEL_SQL, "C6-C9: null users, times, amounts; one user with a third of the rows"),
        Query("velocity_24h_dirty_bucketed", _velocity_run(True), VEL_SQL, "the same on the bucketed shape"),
        Query("spend_percentile_dirty", _pct_run(False), PCT_SQL, "D8 with null users, times, amounts"),
        Query("spend_percentile_dirty_distributed", _pct_run(True), PCT_SQL, "the same on the distributed shape"),
        Query("asof_counters_dirty", _asof_run(None), ASOF_SQL, "G6, G8: undated events come last, events without a user stand alone"),
        Query("asof_counters_dirty_distributed", _asof_run(0), ASOF_SQL, "the same on the distributed shape"),
        Query("store_upsert_nulls_one_batch", _upsert_run(1), UPS_SQL, "G4: null fields keep the older value"),
        Query("store_upsert_nulls_two_batches", _upsert_run(2), UPS_SQL, "G4: the batch cut does not matter"),
        Query("concat_batches_events", _concat_run, CAT_SQL, "A11-A12"),
        Query("result_table_events", _result_run, RES_SQL, "H9, A4 with partitions"),
        Query("drift_trailing_events", _trailing_run, TRAIL_SQL, "J10"),
        Query("distance_from_home_events", _home_run(None), HOME_SQL.format(haversine=HAVERSINE), "M6"),
        Query("distance_from_home_events_distributed", _home_run(0), HOME_SQL.format(haversine=HAVERSINE), "M6 on the distributed shape"),
        Query("network_risk_events", _net_run, NET_SQL, "M11: longest-prefix match, nested networks, IPv4 and IPv6"),
        Query("ip_risk_events", _ip_run, IPR_SQL.format(mask="regexp_extract(ip, '^([0-9]+\\.[0-9]+)\\.', 1) || '.x.x'"), "M8, M11"),
        Query("top_features_events", _topk_run, TOPK_SQL, "F8"),
        _reg("registry_version_by_id", lambda r: RG.version_by_id(r, "model_1", 7), "SELECT name, version, stage FROM reg WHERE name = 'model_1' AND version = 7", "L19"),
        _reg("registry_promote", lambda r: RG.promote(r, "model_1", 7), "SELECT name, version, CASE WHEN name = 'model_1' AND version = 7 THEN 'Production' "
             "WHEN name = 'model_1' AND stage = 'Production' THEN 'Archived' ELSE stage END AS stage FROM reg", "L22"),
        _reg("registry_archive", lambda r: RG.archive(r, "model_2", 10), "SELECT name, version, CASE WHEN name = 'model_2' AND version = 10 THEN 'Archived' ELSE stage END AS stage FROM reg", "L22"),
        _reg("registry_staging_to_production", lambda r: RG.staging_to_production(r), "SELECT name, version, CASE WHEN stage = 'Staging' AND version = "
             "max(CASE WHEN stage = 'Staging' THEN version END) OVER (PARTITION BY name) THEN 'Production' WHEN stage = 'Production' AND "
             "max(CASE WHEN stage = 'Staging' THEN version END) OVER (PARTITION BY name) IS NOT NULL THEN 'Archived' ELSE stage END AS stage FROM reg", "L22"),
    )
