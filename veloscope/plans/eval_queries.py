"""Registered evaluation queries (I1-I17) and their DuckDB oracles."""

from __future__ import annotations

from veloscope import constants as K
from veloscope.operators import evaluation as EV
from veloscope.plans.common import Query, project, registry, sql_select
from veloscope.sources.transactions import SOURCES

RT = [f"prec_at_{int(round(t * 100))}recall" for t in K.RECALL_TARGETS]
METRICS = (["auc_roc", "auc_pr", "gini", "ks_statistic", "precision_t50", "recall_t50", "f1_t50", "f2_t50",
            "optimal_threshold", "optimal_youden_j", "precision_optimal", "recall_optimal", "f1_optimal"] + RT
           + ["brier_score", "log_loss", "fraud_rate", "n_samples", "n_fraud"]
           + [f"fraud_catch_rate_top{p}pct" for p in K.CATCH_RATE_PCTS])
CM = ["cm_true_positives", "cm_false_positives", "cm_false_negatives", "cm_true_negatives"]


def _kinds(by, prefix="test"):
    out = {b: "s" for b in by}
    out.update({f"{prefix}_{m}": "d" for m in METRICS})
    out.update({f"{prefix}_{m}": "l" for m in CM})
    return out


def _f(p, r, b2=1.0):
    return f"CASE WHEN ({b2} * {p} + {r}) > 0 THEN (1 + {b2}) * {p} * {r} / ({b2} * {p} + {r}) ELSE 0 END"


def _div(a, b):
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0 END"


def eval_sql(source: str | None, by: list[str], prefix: str = "test", rel: str | None = None,
             kinds: dict | None = None, places: int | None = None) -> str:
    """``rel``: a CTE list ending in a relation named ``txn`` (used instead of a source)."""
    g = ("GROUP BY " + ", ".join(by)) if by else ""
    gsel = (", ".join(by) + ", ") if by else ""
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    using = f"USING ({', '.join(by)})" if by else "ON TRUE"
    eps = K.PROB_CLIP
    rt = ",\n       ".join(f"coalesce(max(CASE WHEN {_div('tp', 'tpos')} >= {t} THEN {_div('tp', 'tp + fp')} END), 0)"
                           f" AS prec_at_{int(round(t * 100))}recall" for t in K.RECALL_TARGETS)
    cr = ",\n       ".join(f"sum(CASE WHEN rn <= greatest(1, floor(n * {p} / 100)) THEN is_fraud ELSE 0 END)"
                           f" / greatest(sum(is_fraud), 1) AS fraud_catch_rate_top{p}pct" for p in K.CATCH_RATE_PCTS)
    head = rel if rel else SOURCES[source][1]
    body = f"""WITH {head},
v AS (SELECT * FROM txn WHERE score IS NOT NULL AND is_fraud IS NOT NULL),
d AS (SELECT {gsel}score AS p, CAST(sum(is_fraud) AS DOUBLE) AS pos, CAST(sum(1 - is_fraud) AS DOUBLE) AS neg
      FROM v GROUP BY {gsel}score),
c AS (SELECT *, sum(pos) OVER (w ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (w ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER w AS tpos, sum(neg) OVER w AS tneg
      FROM d WINDOW w AS ({part})),
c2 AS (SELECT *, {_div('tp', 'tpos')} - {_div('fp', 'tneg')} AS j FROM c),
best AS (SELECT {gsel}CASE WHEN j <= 0 THEN 'inf'::DOUBLE ELSE p END AS optimal_threshold, greatest(j, 0) AS optimal_youden_j,
                CASE WHEN j <= 0 THEN 0 ELSE tp END AS btp, CASE WHEN j <= 0 THEN 0 ELSE fp END AS bfp
         FROM (SELECT *, row_number() OVER ({part} ORDER BY j DESC, p DESC) AS rn FROM c2) WHERE rn = 1),
m AS (SELECT {gsel}any_value(tpos) AS tpos, any_value(tneg) AS tneg,
       CASE WHEN any_value(tpos) > 0 AND any_value(tneg) > 0 THEN sum(neg * (tp - pos / 2)) / (any_value(tpos) * any_value(tneg)) END AS auc_roc,
       CASE WHEN any_value(tpos) > 0 THEN sum(pos * {_div('tp', 'tp + fp')}) / any_value(tpos) END AS auc_pr,
       CASE WHEN any_value(tpos) > 0 AND any_value(tneg) > 0 THEN max(abs({_div('tp', 'tpos')} - {_div('fp', 'tneg')})) ELSE 0 END AS ks_statistic,
       coalesce(max(CASE WHEN p >= {K.FRAUD_LABEL_THRESHOLD} THEN tp END), 0) AS tp_t,
       coalesce(max(CASE WHEN p >= {K.FRAUD_LABEL_THRESHOLD} THEN fp END), 0) AS fp_t,
       {rt}
      FROM c {g}),
cal AS (SELECT {gsel}avg(power(score - is_fraud, 2)) AS brier_score,
               -avg(is_fraud * ln(least(greatest(score, {eps}), 1 - {eps}))
                    + (1 - is_fraud) * ln(1 - least(greatest(score, {eps}), 1 - {eps}))) AS log_loss,
               avg(CAST(is_fraud AS DOUBLE)) AS fraud_rate, CAST(count(*) AS DOUBLE) AS n_samples,
               CAST(sum(is_fraud) AS DOUBLE) AS n_fraud
        FROM v {g}),
r AS (SELECT *, row_number() OVER ({part} ORDER BY score DESC, transaction_id) AS rn, count(*) OVER ({part}) AS n FROM v),
cr AS (SELECT {gsel}{cr} FROM r {g}),
o AS (SELECT *, {_div('tp_t', 'tp_t + fp_t')} AS precision_t50, {_div('tp_t', 'tpos')} AS recall_t50,
             {_div('btp', 'btp + bfp')} AS precision_optimal, {_div('btp', 'tpos')} AS recall_optimal
      FROM m JOIN best {using} JOIN cal {using} JOIN cr {using}),
f AS (SELECT *, 2 * auc_roc - 1 AS gini, {_f('precision_t50', 'recall_t50')} AS f1_t50,
             {_f('precision_t50', 'recall_t50', 4.0)} AS f2_t50,
             {_f('precision_optimal', 'recall_optimal')} AS f1_optimal,
             btp AS cm_true_positives, bfp AS cm_false_positives, tpos - btp AS cm_false_negatives,
             tneg - bfp AS cm_true_negatives FROM o),
q AS (SELECT {gsel}{', '.join((f'round({m}, {places})' if places and m in METRICS else m) + f' AS {prefix}_{m}'
                              for m in METRICS + CM)} FROM f)
SELECT {sql_select(kinds or _kinds(by, prefix))} FROM q"""
    return body


def _eval(name, source, by, doc):
    def run(spark, sf_dir):
        return project(EV.evaluate(SOURCES[source][0](spark, sf_dir), by=by, prefix="test"), _kinds(by))
    return Query(name, run, eval_sql(source, by), doc)


THR = {"threshold": "d", "precision": "d", "recall": "d", "f1": "d", "n_flagged": "l", "flag_rate_pct": "d"}


def _thr_sql(source):
    start, stop, n = K.THRESHOLD_GRID
    ts = ", ".join(repr(start + (stop - start) * i / (n - 1)) for i in range(n))
    return f"""WITH {SOURCES[source][1]},
t AS (SELECT unnest([{ts}]) AS threshold),
a AS (SELECT threshold, count(*) FILTER (WHERE is_fraud = 1 AND score >= threshold) AS tp,
             count(*) FILTER (WHERE score >= threshold) AS fl, count(*) AS n,
             count(*) FILTER (WHERE is_fraud = 1) AS pos
      FROM t CROSS JOIN txn GROUP BY threshold),
b AS (SELECT threshold, {_div('tp', 'fl')} AS precision, {_div('tp', 'pos')} AS recall, fl AS n_flagged,
             fl / n * 100 AS flag_rate_pct FROM a),
q AS (SELECT *, {_f('precision', 'recall')} AS f1 FROM b)
SELECT {sql_select(THR)} FROM q"""


REPORT = {"label": "s", "precision": "d", "recall": "d", "f1": "d", "support": "d"}


def _report_run(spark, sf_dir):
    txn = SOURCES["events"][0](spark, sf_dir)
    m = EV.curve_metrics(EV.score_curve(txn))
    return project(EV.classification_report(m), REPORT)


def _report_sql():
    base = eval_sql("events", [], "test").rsplit("SELECT", 1)[0]
    tp, fp, fn, tn = (f"CAST(test_{c} AS DOUBLE)" for c in CM)
    p1, r1, p0, r0 = _div(tp, f"{tp} + {fp}"), _div(tp, f"{tp} + {fn}"), _div(tn, f"{tn} + {fn}"), _div(tn, f"{tn} + {fp}")
    return base + f"""SELECT {sql_select(REPORT)} FROM (
  SELECT 'Legitimate' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM z UNION ALL
  SELECT 'Fraud', p1, r1, f1, s1 FROM z UNION ALL
  SELECT 'accuracy', acc, acc, acc, s0 + s1 FROM z UNION ALL
  SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM z UNION ALL
  SELECT 'weighted avg', {_div('p0 * s0 + p1 * s1', 's0 + s1')}, {_div('r0 * s0 + r1 * s1', 's0 + s1')},
         {_div('f0 * s0 + f1 * s1', 's0 + s1')}, s0 + s1 FROM z)""".replace(
        "FROM z", f"""FROM (SELECT *, {_f('p0', 'r0')} AS f0, {_f('p1', 'r1')} AS f1 FROM (
      SELECT {p1} AS p1, {r1} AS r1, {p0} AS p0, {r0} AS r0, {tp} + {fn} AS s1, {tn} + {fp} AS s0,
             {_div(f'{tp} + {tn}', f'{tp} + {fn} + {tn} + {fp}')} AS acc FROM q))""")


CURVE = {"threshold": "d", "fpr": "d", "tpr": "d", "precision": "d", "recall": "d"}


def _curve_sql(source):
    return f"""WITH {SOURCES[source][1]},
d AS (SELECT score AS p, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM txn
      WHERE score IS NOT NULL AND is_fraud IS NOT NULL GROUP BY score),
c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER () AS tpos, sum(neg) OVER () AS tneg FROM d),
q AS (SELECT p AS threshold, {_div('fp', 'tneg')} AS fpr, {_div('tp', 'tpos')} AS tpr,
             {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tpos')} AS recall FROM c)
SELECT {sql_select(CURVE)} FROM q"""


def build():
    return registry(
        _eval("evaluation_events", "events", [], "I1-I12, I15: full metric row (prefix test_)"),
        _eval("evaluation_by_category_events", "events", ["merchant_category"], "I1-I15 per merchant category"),
        _eval("evaluation_orders", "orders", [], "I1-I15 on 4-decimal scores"),
        Query("threshold_table_events",
              lambda s, d: project(EV.threshold_table(SOURCES["events"][0](s, d)), THR), _thr_sql("events"),
              "I14: 20-point threshold table"),
        Query("classification_report_events", _report_run, _report_sql(), "I12-I13 at the optimal threshold"),
        Query("roc_pr_curve_orders",
              lambda s, d: project(EV.roc_points(EV.score_curve(SOURCES["orders"][0](s, d))), CURVE),
              _curve_sql("orders"), "I17: ROC and PR points"),
    )
