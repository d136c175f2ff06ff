"""Registered split, backtest, gate and registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.functions.columns import round_to
from veloscope.operators import evaluation as EV
from veloscope.operators import registry as RG
from veloscope.operators import splits as SP
from veloscope.plans.common import Query, project, registry, sql_select
from veloscope.plans.eval_queries import METRICS, eval_sql
from veloscope.session import cut_lineage
from veloscope.sources.transactions import SOURCES

HASH_SQL = "CAST('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || '|{seed}'), 1, 15) AS BIGINT)"


def _pos_sql(source: str) -> str:
    return f"""WITH {SOURCES[source][1]},
h AS (SELECT *, {HASH_SQL.format(seed=K.SPLIT_SEED)} AS hk FROM txn),
r AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY hk, transaction_id) AS pos,
             count(*) OVER (PARTITION BY is_fraud) AS n FROM h)"""


SPLIT = {"transaction_id": "l", "is_fraud": "l", "split": "s"}
FOLD = {"transaction_id": "l", "is_fraud": "l", "fold": "l"}
vf = K.VAL_SIZE / (1 - K.TEST_SIZE)
SPLIT_SQL = _pos_sql("orders") + f""",
s AS (SELECT *, ceil(n * {K.TEST_SIZE}) AS nt FROM r),
q AS (SELECT *, CASE WHEN pos <= nt THEN 'test' WHEN pos <= nt + ceil((n - nt) * {vf!r}) THEN 'val'
                     ELSE 'train' END AS split FROM s)
SELECT {sql_select(SPLIT)} FROM q"""
FOLD_SQL = _pos_sql("events") + f""",
q AS (SELECT *, (pos - 1) % {K.CV_FOLDS} AS fold FROM r)
SELECT {sql_select(FOLD)} FROM q"""

WEIGHT = {"n_neg": "l", "n_pos": "l", "pos_weight": "d"}
WEIGHT_SQL = f"""WITH {SOURCES['events'][1]},
q AS (SELECT count(*) FILTER (WHERE is_fraud = 0) AS n_neg, count(*) FILTER (WHERE is_fraud = 1) AS n_pos FROM txn)
SELECT {sql_select({'n_neg': 'l', 'n_pos': 'l'})}, round(CASE WHEN n_pos > 0 THEN n_neg / n_pos END, 6) AS pos_weight FROM q"""

# ---------------------------------------------------------------------------
# walk-forward backtest over orders (6.5 years of day-grain orders)
# ---------------------------------------------------------------------------
WIN = {"window_id": "l", "train_start": "t", "train_end": "t", "test_end": "t", "n_train": "l", "n_test": "l",
       "n_train_fraud": "l", "n_test_fraud": "l", "train_fraud_rate": "d", "status": "s"}


def _backtest_rows(spark, sf_dir):
    txn = SOURCES["orders"][0](spark, sf_dir)
    w = SP.walk_forward_windows(txn)
    return txn, w, SP.assign_windows(txn, w)


def _windows_run(spark, sf_dir):
    txn = SOURCES["orders"][0](spark, sf_dir)
    w = SP.walk_forward_windows(txn)
    st = SP.window_stats_aligned(txn, w) if SP.aligned() else SP.window_stats(SP.assign_windows(txn, w), w)
    return project(st, WIN)


def _windows_range_join_run(spark, sf_dir):
    txn, w, rows = _backtest_rows(spark, sf_dir)
    return project(SP.window_stats(rows, w), WIN)


def _windows_cte(src: str = "txn") -> str:
    cte = SOURCES["orders"][1].replace("txn AS (", f"{src} AS (", 1)
    return f"""{cte},
mm AS (SELECT min("timestamp") AS t0, max("timestamp") AS t1 FROM {src}),
w AS (SELECT row_number() OVER (ORDER BY cut) AS window_id, cut - INTERVAL {K.BACKTEST_TRAIN_DAYS} DAYS AS train_start,
             cut AS train_end, cut + INTERVAL {K.BACKTEST_TEST_DAYS} DAYS AS test_end
      FROM (SELECT unnest(generate_series(t0 + INTERVAL {K.BACKTEST_TRAIN_DAYS} DAYS,
                                          t1 - INTERVAL {K.BACKTEST_TEST_DAYS} DAYS,
                                          INTERVAL {K.BACKTEST_STEP_DAYS} DAYS)) AS cut FROM mm)),
rows AS (SELECT {src}.*, w.*, CASE WHEN "timestamp" < train_end THEN 'train' ELSE 'test' END AS role
         FROM {src} JOIN w ON "timestamp" >= train_start AND "timestamp" < test_end),
st AS (SELECT w.*, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test,
              count(*) FILTER (WHERE role = 'train' AND is_fraud = 1) AS n_train_fraud,
              count(*) FILTER (WHERE role = 'test' AND is_fraud = 1) AS n_test_fraud
       FROM w LEFT JOIN rows USING (window_id) GROUP BY ALL),
ws AS (SELECT *, n_train_fraud / greatest(n_train, 1) AS train_fraud_rate,
              CASE WHEN n_train_fraud < {K.BACKTEST_MIN_TRAIN_FRAUD} OR n_test_fraud < {K.BACKTEST_MIN_TEST_FRAUD}
                   THEN 'skipped: insufficient fraud'
                   WHEN n_train < {K.BACKTEST_MIN_TRAIN_ROWS} THEN 'skipped: insufficient training data'
                   ELSE 'ok' END AS status FROM st)"""


WINDOWS_CTE = _windows_cte()

BT_METRICS = {"window_id": "l", **{f"backtest_{m}": "d" for m in METRICS}}


def _bt_eval(spark, sf_dir):
    txn = SOURCES["orders"][0](spark, sf_dir)
    w = SP.walk_forward_windows(txn)
    if SP.aligned():
        ok = SP.window_stats_aligned(txn, w).where(F.col("status") == "ok").select("window_id")
        # one copy of the table (each row tests one window), read by the curve and the tie step
        test = cut_lineage(SP.test_rows(txn, w).join(F.broadcast(ok), "window_id", "left_semi"))
    else:
        rows = SP.assign_windows(txn, w)
        ok = SP.window_stats(rows, w).where(F.col("status") == "ok").select("window_id")
        test = rows.where(F.col("role") == "test").join(ok, "window_id", "left_semi")
    m = EV.evaluate(test, by=["window_id"], prefix="backtest")
    # window metrics are reported to 5 places
    return m.select("window_id", *[round_to(f"backtest_{x}", 5).alias(f"backtest_{x}") for x in METRICS])


def _bt_eval_sql():
    rel = _windows_cte("otx") + """,
txn2 AS (SELECT rows.* FROM rows JOIN ws USING (window_id) WHERE role = 'test' AND status = 'ok'),
txn AS (SELECT * FROM txn2)"""
    return eval_sql(None, ["window_id"], "backtest", rel=rel, kinds=BT_METRICS, places=5)


SUMMARY = {"windows_completed": "l", **{f"{m}_{s}": "d" for m in ("auc_roc", "auc_pr", "recall_optimal")
                                        for s in ("mean", "std", "min", "max")}, "stable": "l"}


def _bt_summary_run(spark, sf_dir):
    txn = SOURCES["orders"][0](spark, sf_dir)
    st = SP.window_stats_aligned(txn, SP.walk_forward_windows(txn))
    m = _bt_eval(spark, sf_dir)
    per = st.join(m, "window_id", "left")
    return project(SP.backtest_summary(per), SUMMARY)


def _bt_summary_sql():
    base = _bt_eval_sql()
    head, _ = base.rsplit("SELECT", 1)
    aggs = ", ".join(f"avg(backtest_{m}) AS {m}_mean, stddev_pop(backtest_{m}) AS {m}_std, "
                     f"min(backtest_{m}) AS {m}_min, max(backtest_{m}) AS {m}_max"
                     for m in ("auc_roc", "auc_pr", "recall_optimal"))
    return head + f"""SELECT {sql_select(SUMMARY)} FROM (
  SELECT count(*) AS windows_completed, {aggs},
         CAST(stddev_pop(backtest_auc_pr) <= {K.BACKTEST_STABLE_STD} AS INTEGER) AS stable FROM q)"""


# ---------------------------------------------------------------------------
# registry derived from events: one version per (model, day of month)
# ---------------------------------------------------------------------------

def registry_table(spark, sf_dir):
    txn = SOURCES["events"][0](spark, sf_dir).withColumns({
        "name": F.concat(F.lit("model_"), (F.col("user_id") % 3).cast("string")),
        "version": F.dayofmonth("timestamp").cast("long")})
    m = EV.curve_metrics(EV.score_curve(txn, by=["name", "version"]), by=["name", "version"])
    created = txn.groupBy("name", "version").agg(F.min("timestamp").alias("creation_timestamp"))
    metrics = F.map_filter(F.create_map(F.lit("auc_pr"), F.col("auc_pr"), F.lit("auc_roc"), F.col("auc_roc")),
                           lambda k, v: v.isNotNull())
    v = F.col("version")
    stage = (F.when(v % 10 == 0, "Production").when(v % 7 == 0, "Staging").when(v % 5 == 0, "Archived")
             .otherwise("None"))
    return m.join(created, ["name", "version"]).select(
        "name", "version", stage.alias("stage"),
        F.md5(F.concat_ws("/", "name", F.col("version").cast("string"))).alias("run_id"),
        "creation_timestamp", F.lit("daily model").alias("description"), metrics.alias("metrics"),
        F.create_map(F.lit("source"), F.lit("events")).alias("tags"))


REG_CTE = f"""{SOURCES['events'][1]},
rt AS (SELECT *, 'model_' || CAST(user_id % 3 AS VARCHAR) AS name, CAST(day("timestamp") AS BIGINT) AS version FROM txn),
d AS (SELECT name, version, score AS p, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM rt GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY name, version ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (PARTITION BY name, version ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER (PARTITION BY name, version) AS tpos, sum(neg) OVER (PARTITION BY name, version) AS tneg FROM d),
reg AS (SELECT name, version,
               CASE WHEN version % 10 = 0 THEN 'Production' WHEN version % 7 = 0 THEN 'Staging'
                    WHEN version % 5 = 0 THEN 'Archived' ELSE 'None' END AS stage,
               CASE WHEN any_value(tpos) > 0 THEN sum(pos * tp / (tp + fp)) / any_value(tpos) END AS auc_pr
        FROM c GROUP BY name, version)"""

LIST = {"name": "s", "version": "l", "stage": "s", "rank": "l"}
BEST = {"name": "s", "version": "l", "auc_pr": "d"}
CMP = {"name": "s", "version": "l", "auc_pr": "d", "rank": "l"}
PROMO = {"name": "s", "version": "l", "stage": "s"}


def _reg_q(name, fn, kinds, body, doc):
    def run(spark, sf_dir):
        return project(fn(registry_table(spark, sf_dir)), kinds)
    return Query(name, run, f"WITH {REG_CTE},\nq AS ({body})\nSELECT {sql_select(kinds)} FROM q", doc)


GATE = {"window_id": "l", "backtest_auc_pr": "d", "gate": "s"}


def _gate_run(spark, sf_dir):
    m = _bt_eval(spark, sf_dir)
    return project(RG.quality_gate(m, "backtest_auc_pr"), GATE)


def _gate_sql():
    head, _ = _bt_eval_sql().rsplit("SELECT", 1)
    return head + f"""SELECT {sql_select(GATE)} FROM (SELECT window_id, backtest_auc_pr,
  CASE WHEN backtest_auc_pr >= {K.REGISTER_MIN_AUC_PR} THEN 'register' WHEN backtest_auc_pr >= {K.FAIL_BELOW_AUC_PR}
       THEN 'keep' ELSE 'fail' END AS gate FROM q)"""


REGISTERED = {"name": "s", "version": "l", "stage": "s", "run_id": "s"}


def _register_run(spark, sf_dir):
    reg = registry_table(spark, sf_dir)
    new = (reg.groupBy("name").agg(F.max("creation_timestamp").alias("creation_timestamp"))
              .select("name", F.md5(F.concat(F.col("name"), F.lit("/retrain"))).alias("run_id"),
                      F.col("creation_timestamp"), F.lit("retrained").alias("description"),
                      F.create_map(F.lit("auc_pr"), F.lit(0.0)).alias("metrics"),
                      F.create_map(F.lit("source"), F.lit("retrain")).alias("tags")))
    return project(RG.register(reg, new), REGISTERED)


def build():
    return registry(
        Query("stratified_split_orders",
              lambda s, d: project(SP.stratified_split(SOURCES["orders"][0](s, d)), SPLIT), SPLIT_SQL,
              "L1 exact stratified 70/15/15 split by seeded hash"),
        Query("stratified_folds_events",
              lambda s, d: project(SP.stratified_folds(SOURCES["events"][0](s, d)), FOLD), FOLD_SQL,
              "L2 stratified 5 folds"),
        Query("class_weight_events",
              lambda s, d: project(SP.class_weight(SOURCES["events"][0](s, d)), WEIGHT), WEIGHT_SQL, "L7"),
        Query("backtest_windows_orders", _windows_run,
              f"WITH {WINDOWS_CTE}\nSELECT {sql_select(WIN)} FROM ws", "L3-L4 walk-forward windows and skip rules"),
        Query("backtest_windows_range_join_orders", _windows_range_join_run,
              f"WITH {WINDOWS_CTE}\nSELECT {sql_select(WIN)} FROM ws",
              "L3-L4 through the general broadcast range join (any train/test/step lengths)"),
        Query("backtest_metrics_orders", lambda s, d: project(_bt_eval(s, d), BT_METRICS), _bt_eval_sql(),
              "L5 per-window evaluation of the given scores"),
        Query("backtest_summary_orders", _bt_summary_run, _bt_summary_sql(), "L6 summary and stability"),
        Query("quality_gate_backtest", _gate_run, _gate_sql(), "L17 register / keep / fail gate per window"),
        _reg_q("registry_list_production", lambda r: RG.list_versions(r, "Production"), LIST,
               "SELECT name, version, stage, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS rank "
               "FROM reg WHERE stage = 'Production'", "L18"),
        _reg_q("registry_latest_staging", lambda r: RG.latest_version(r, "Staging"), {"name": "s", "version": "l"},
               "SELECT name, max(version) AS version FROM reg WHERE stage = 'Staging' GROUP BY name", "L19"),
        _reg_q("registry_compare", lambda r: RG.compare_versions(r, "auc_pr"), CMP,
               "SELECT name, version, coalesce(auc_pr, 0) AS auc_pr, row_number() OVER (PARTITION BY name "
               "ORDER BY coalesce(auc_pr, 0) DESC, version DESC) AS rank FROM reg", "L20"),
        _reg_q("registry_best", lambda r: RG.best_version(r, "auc_pr"), BEST,
               "SELECT name, arg_max(version, (coalesce(auc_pr, 0), version)) AS version, "
               "max(coalesce(auc_pr, 0)) AS auc_pr FROM reg GROUP BY name", "L21"),
        _reg_q("registry_promote_best", lambda r: RG.promote_best(r, "auc_pr"), PROMO,
               "SELECT r.name, r.version, CASE WHEN r.version = b.bv THEN 'Production' WHEN r.stage = 'Production' "
               "THEN 'Archived' ELSE r.stage END AS stage FROM reg r JOIN (SELECT name, arg_max(version, "
               "(coalesce(auc_pr, 0), version)) AS bv FROM reg GROUP BY name) b USING (name)", "L22"),
        Query("registry_register", _register_run,
              f"WITH {REG_CTE},\nq AS (SELECT name, version, stage, md5(name || '/' || CAST(version AS VARCHAR)) AS run_id"
              f" FROM reg UNION ALL SELECT name, max(version) + 1, 'None', md5(name || '/retrain') FROM reg GROUP BY name)"
              f"\nSELECT {sql_select(REGISTERED)} FROM q", "L23"),
    )
