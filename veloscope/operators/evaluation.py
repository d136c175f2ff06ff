"""Evaluation of scores against labels (I1-I17), optionally per group.

Everything ordered is derived from one **score curve**: one row per
(group, distinct score) with the positives/negatives at that score and the
cumulative tp/fp at threshold ``score >= p``. The curve is built without a
global sort:

1. collapse rows to distinct scores (partial aggregation);
2. running totals over balanced range partitions (``prefix.running_sums``, descending).

AUC, average precision, KS, Youden's J, precision at recall targets and the
confusion numbers are then plain aggregates over the curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators.prefix import running_sums
from veloscope.session import cut_lineage


def _grp(by: Sequence[str]) -> list[str]:
    return list(by)


def score_curve(df: DataFrame, label: str = "is_fraud", score: str = "score", by: Sequence[str] = ()
                ) -> DataFrame:
    """Columns: by..., p, pos, neg, tp, fp, tot_pos, tot_neg (tp/fp count rows with score >= p)."""
    by = _grp(by)
    y = F.col(label).cast("long")
    pts = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
             .groupBy(*by, F.col(score).cast("double").alias("p"))
             .agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")))
    r = running_sums(pts, by, "p", ["pos", "neg"], descending=True)
    return r.select(*by, "p", "pos", "neg", F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp"),
                    "tot_pos", "tot_neg")


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f(prec: Column, rec: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return F.when((b2 * prec + rec) > 0, (1 + b2) * prec * rec / (b2 * prec + rec)).otherwise(F.lit(0.0))


def curve_metrics(curve: DataFrame, by: Sequence[str] = (), threshold: float = K.FRAUD_LABEL_THRESHOLD,
                  recall_targets: Sequence[float] = K.RECALL_TARGETS) -> DataFrame:
    """I1-I8, I12 from the curve, one row per group."""
    by = _grp(by)
    P, N = F.col("tot_pos").cast("double"), F.col("tot_neg").cast("double")
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    prec = _div(tp, tp + fp)
    rec = _div(tp, P)
    j = _div(tp, P) - _div(fp, N)
    aggs = [
        F.first("tot_pos").alias("n_pos"), F.first("tot_neg").alias("n_neg"),
        F.sum(F.col("neg") * (tp - F.col("pos") / 2.0)).alias("_auc_num"),
        F.sum(F.col("pos") * prec).alias("_ap_num"),
        F.max(F.abs(_div(tp, P) - _div(fp, N))).alias("ks_statistic"),
        # Youden: highest J, ties → highest threshold; the (+inf, J=0) point flags nothing
        F.max_by(F.struct(F.col("p"), tp.alias("tp"), fp.alias("fp")), F.struct(j, F.col("p"))).alias("_best"),
        F.max(j).alias("_bestj"),
        F.coalesce(F.max(F.when(F.col("p") >= threshold, tp)), F.lit(0.0)).alias("_tp_t"),
        F.coalesce(F.max(F.when(F.col("p") >= threshold, fp)), F.lit(0.0)).alias("_fp_t"),
    ]
    for t in recall_targets:
        aggs.append(F.coalesce(F.max(F.when(rec >= t, prec)), F.lit(0.0)).alias(f"prec_at_{int(round(t * 100))}recall"))
    g = curve.groupBy(*by).agg(*aggs) if by else curve.agg(*aggs)
    inf_wins = (F.col("_bestj") <= 0)
    bt = F.when(inf_wins, F.lit(float("inf"))).otherwise(F.col("_best.p"))
    btp = F.when(inf_wins, F.lit(0.0)).otherwise(F.col("_best.tp"))
    bfp = F.when(inf_wins, F.lit(0.0)).otherwise(F.col("_best.fp"))
    Pd, Nd = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    p_t, r_t = _div(F.col("_tp_t"), F.col("_tp_t") + F.col("_fp_t")), _div(F.col("_tp_t"), Pd)
    p_o, r_o = _div(btp, btp + bfp), _div(btp, Pd)
    auc = F.when((Pd > 0) & (Nd > 0), F.col("_auc_num") / (Pd * Nd))
    out = g.select(
        *by,
        auc.alias("auc_roc"),
        F.when(Pd > 0, F.col("_ap_num") / Pd).alias("auc_pr"),
        (2 * auc - 1).alias("gini"),
        F.when((Pd > 0) & (Nd > 0), F.col("ks_statistic")).otherwise(F.lit(0.0)).alias("ks_statistic"),
        p_t.alias("precision_t50"), r_t.alias("recall_t50"), _f(p_t, r_t).alias("f1_t50"),
        _f(p_t, r_t, 2.0).alias("f2_t50"),
        bt.alias("optimal_threshold"), F.greatest(F.col("_bestj"), F.lit(0.0)).alias("optimal_youden_j"),
        p_o.alias("precision_optimal"), r_o.alias("recall_optimal"), _f(p_o, r_o).alias("f1_optimal"),
        *[f"prec_at_{int(round(t * 100))}recall" for t in recall_targets],
        btp.cast("long").alias("cm_true_positives"), bfp.cast("long").alias("cm_false_positives"),
        (Pd - btp).cast("long").alias("cm_false_negatives"), (Nd - bfp).cast("long").alias("cm_true_negatives"),
    )
    return out


def calibration_from_curve(curve: DataFrame, by: Sequence[str] = (), eps: float = K.PROB_CLIP) -> DataFrame:
    """I9-I10 from the distinct-score table: each score carries its positive and negative counts."""
    by = _grp(by)
    p = F.col("p")
    pc = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    aggs = [F.sum(pos * F.pow(p - 1, 2) + neg * F.pow(p, 2)).alias("_bs"),
            F.sum(pos * F.log(pc) + neg * F.log(1 - pc)).alias("_ll"),
            F.sum(pos).alias("n_fraud"), F.sum(pos + neg).alias("n_samples")]
    g = curve.groupBy(*by).agg(*aggs) if by else curve.agg(*aggs)
    return g.select(*by, (F.col("_bs") / F.col("n_samples")).alias("brier_score"),
                    (-F.col("_ll") / F.col("n_samples")).alias("log_loss"),
                    (F.col("n_fraud") / F.col("n_samples")).alias("fraud_rate"), "n_samples", "n_fraud")


def catch_rates(df: DataFrame, label: str = "is_fraud", score: str = "score", id_col: str = "transaction_id",
                by: Sequence[str] = (), pcts: Sequence[int] = K.CATCH_RATE_PCTS,
                curve: DataFrame | None = None) -> DataFrame:
    """Share of all fraud inside the top k% by score, k = max(1, floor(n*pct/100)); ties by id.

    Everything strictly above the boundary score comes from the score curve;
    only the boundary tie group is ordered, by id (any orderable type), with running counts,
    so even a tie group holding most rows is spread over many tasks.
    """
    by = _grp(by)
    base = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    cur = curve if curve is not None else score_curve(base, label, score, by)
    n = F.col("tot_pos") + F.col("tot_neg")
    here = F.col("pos") + F.col("neg")
    above = F.col("tp") + F.col("fp") - here
    pk = cur.select(*by, "p", "tot_pos", "tp", "pos", here.alias("_here"), above.alias("_above"),
                    F.explode(F.array(*[F.struct(F.lit(p).alias("pct"),
                                                 F.greatest(F.lit(1), F.floor(n * p / 100)).alias("k"))
                                        for p in pcts])).alias("_t"))
    # one boundary row per (group, pct): at most groups x len(pcts) rows
    bnd = pk.where((F.col("_above") < F.col("_t.k")) & (F.col("_t.k") <= F.col("_above") + F.col("_here"))) \
            .select(*by, F.col("p").alias("_p"), F.col("_t.pct").alias("pct"),
                    (F.col("_t.k") - F.col("_above")).alias("_m"), (F.col("tp") - F.col("pos")).alias("_tp_above"),
                    "tot_pos")
    bj = bnd.select(*[F.col(b).alias(f"_g_{b}") for b in by], "_p", "pct", "_m")
    cond = [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by] + [F.col(score) == F.col("_p")]
    ties = base.select(*by, score, id_col, label).join(bj, cond, "inner") \
               .select(*by, "pct", "_m", F.col(id_col).alias("_id"), F.col(label).cast("long").alias("_y"),
                       F.lit(1).alias("_one"))
    r = running_sums(ties, [*by, "pct"], "_id", ["_one"])
    in_ties = r.groupBy(*by, "pct").agg(F.sum(F.when(F.col("run__one") <= F.col("_m"), F.col("_y")).otherwise(0))
                                        .alias("_tie_pos"))
    rates = join_groups(bnd, in_ties, [*by, "pct"], "left").select(
        *by, "pct", ((F.col("_tp_above") + F.coalesce("_tie_pos", F.lit(0)))
                     / F.greatest(F.col("tot_pos"), F.lit(1))).alias("rate"))
    g = rates.groupBy(*by) if by else rates.groupBy()
    return g.agg(*[F.coalesce(F.max(F.when(F.col("pct") == p, F.col("rate"))), F.lit(0.0))
                   .alias(f"fraud_catch_rate_top{p}pct") for p in pcts])


def join_groups(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` with the columns of ``b`` by group; the group whose key is null is a group too."""
    b = b.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    return a.join(b, same, how).drop(*[f"_j_{k}" for k in keys])


def evaluate(df: DataFrame, label: str = "is_fraud", score: str = "score", id_col: str = "transaction_id",
             by: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """The full metric row (per group), optionally with ``prefix_`` names."""
    by = _grp(by)
    # the curve (one row per distinct score and group) feeds three aggregates:
    # materialise it once in the shared checkpoint folder (also cuts the plan)
    curve = cut_lineage(score_curve(df, label, score, by))
    m = curve_metrics(curve, by)
    c = calibration_from_curve(curve, by)
    k = catch_rates(df, label, score, id_col, by, curve=curve)
    out = join_groups(join_groups(m, c, by), k, by) if by else m.crossJoin(c).crossJoin(k)
    if prefix:
        out = out.select(*by, *[F.col(x).alias(f"{prefix}_{x}") for x in out.columns if x not in by])
    return out


def threshold_table(df: DataFrame, label: str = "is_fraud", score: str = "score", by: Sequence[str] = (),
                    grid=K.THRESHOLD_GRID) -> DataFrame:
    """precision/recall/f1/n_flagged/flag_rate_pct of the labelled rows at linspace(.1, .95, 20), one pass + stack."""
    by, df = _grp(by), df.where(F.col(label).isNotNull())
    start, stop, n = grid
    ts = [start + (stop - start) * i / (n - 1) for i in range(n)]
    y, p = F.col(label) == 1, F.col(score)
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(y).alias("_pos")]
    for i, t in enumerate(ts):
        aggs += [F.count_if(y & (p >= t)).alias(f"_tp{i}"), F.count_if(p >= t).alias(f"_fl{i}")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    st = ", ".join(f"CAST({t!r} AS DOUBLE), _tp{i}, _fl{i}" for i, t in enumerate(ts))
    rows = g.select(*by, "_n", "_pos", F.expr(f"stack({n}, {st}) AS (threshold, _tp, _fl)"))
    prec = _div(F.col("_tp").cast("double"), F.col("_fl").cast("double"))
    rec = _div(F.col("_tp").cast("double"), F.col("_pos").cast("double"))
    return rows.select(*by, "threshold", prec.alias("precision"), rec.alias("recall"), _f(prec, rec).alias("f1"),
                       F.col("_fl").alias("n_flagged"), (F.col("_fl") / F.col("_n") * 100).alias("flag_rate_pct"))


def classification_report(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class precision/recall/f1/support plus accuracy, macro and weighted averages.

    Built from the confusion counts at the optimal threshold of ``curve_metrics``.
    """
    by = _grp(by)
    tp, fp = F.col("cm_true_positives").cast("double"), F.col("cm_false_positives").cast("double")
    fn, tn = F.col("cm_false_negatives").cast("double"), F.col("cm_true_negatives").cast("double")
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    f1, f0 = _f(p1, r1), _f(p0, r0)
    s1, s0 = tp + fn, tn + fp
    n = s1 + s0
    acc = _div(tp + tn, n)
    rows = F.array(
        F.struct(F.lit("Legitimate").alias("label"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"),
                 s0.alias("support")),
        F.struct(F.lit("Fraud").alias("label"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"),
                 s1.alias("support")),
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"),
                 n.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), _div(p0 * s0 + p1 * s1, n).alias("precision"),
                 _div(r0 * s0 + r1 * s1, n).alias("recall"), _div(f0 * s0 + f1 * s1, n).alias("f1"),
                 n.alias("support")),
    )
    return metrics.select(*by, F.inline(rows))


def roc_points(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC (fpr, tpr) and PR (precision, recall) points per threshold."""
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    return curve.select(*by, F.col("p").alias("threshold"), _div(fp, F.col("tot_neg")).alias("fpr"),
                        _div(tp, F.col("tot_pos")).alias("tpr"), _div(tp, tp + fp).alias("precision"),
                        _div(tp, F.col("tot_pos")).alias("recall"))
