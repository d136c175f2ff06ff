"""Scoring and explanation (H1-H9): all per-row projections, no shuffle.

Contributions arrive as a ``map<string,double>`` column (feature → signed
contribution). Bucketing and top-N run per row with higher-order functions
on that map, so explaining never explodes rows or regroups them by id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.functions import columns as C


def score_batch(df: DataFrame, prob_col: str = "fraud_probability", model_version: str = "unversioned",
                threshold: float = K.FRAUD_LABEL_THRESHOLD, id_col: str = "transaction_id",
                keep: Sequence[str] = ()) -> DataFrame:
    """H1-H3: probability → label, tier, decision, version (the response row) + ``keep`` columns."""
    p = F.col(prob_col).cast("double")
    return df.select(
        F.col(id_col), *[F.col(k) for k in keep if k in df.columns and k != id_col],
        p.alias("fraud_probability"),
        threshold_predict(p, threshold).alias("fraud_label"),
        C.risk_tier(p).alias("risk_tier"),
        C.decision(p).alias("decision"),
        F.lit(model_version).alias("model_version"),
    )


def threshold_predict(p, threshold: float = K.FRAUD_LABEL_THRESHOLD) -> Column:
    """H8."""
    return (C.c(p) >= threshold).cast("int")


def weighted_average(cols: Sequence[str], weights: Sequence[float] = K.ENSEMBLE_WEIGHTS) -> Column:
    """H6: weighted mean of base scores over the non-null ones (all null → null)."""
    num = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in zip(cols, weights)), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in zip(cols, weights)), F.lit(0.0))
    return F.when(den > 0, num / den)


def _matches(key: Column, subs: Sequence[str]) -> Column:
    out = F.lit(False)
    for s in subs:
        out = out | F.contains(key, F.lit(s))
    return out


def contribution_buckets(map_col: str = "contributions", rules=K.CONTRIBUTION_BUCKETS) -> dict[str, Column]:
    """H4: named buckets from an ordered rule list; a key belongs to its first matching rule.

    "max" buckets keep the largest |contribution|, "last" buckets the |value| of
    the last matching key in map order; no matching key → null.
    """
    out = {}
    earlier: list[str] = []
    def keep(subs, prev):
        return lambda k, v: _matches(k, subs) & ~_matches(k, prev)

    for name, subs, how in rules:
        sel = F.map_filter(F.col(map_col), keep(list(subs), list(earlier)))
        vals = F.transform(F.map_values(sel), lambda v: F.abs(v))
        out[name] = F.array_max(vals) if how == "max" else F.element_at(vals, -1)
        out[name] = F.when(F.size(vals) > 0, out[name])
        earlier += list(subs)
    return out


def top_contributions(map_col: str = "contributions", n: int = 8) -> Column:
    """H5: the n largest |contribution| entries as array<struct<feature,value>> (ties by name)."""
    ranked = F.array_sort(F.transform(
        F.map_entries(F.col(map_col)),
        lambda e: F.struct(F.abs(e["value"]).alias("a"), e["key"].alias("feature"), e["value"].alias("value"))),
        lambda x, y: F.when(x["a"] > y["a"], -1).when(x["a"] < y["a"], 1)
        .when(x["feature"] < y["feature"], -1).when(x["feature"] > y["feature"], 1).otherwise(0))
    return F.transform(F.slice(ranked, 1, n), lambda e: F.struct(e["feature"].alias("feature"),
                                                                   e["value"].alias("value")))


def linear_contributions(df: DataFrame, features: Sequence[str], weights: dict[str, float] | None = None,
                         out: str = "contributions") -> DataFrame:
    """Exact SHAP values of a linear score: w_f * (x_f - mean_f).

    With ``weights=None`` the score is the sum of standardised features
    (w_f = 1/std_f). Means and stds come from one global aggregate row,
    cross-joined (a single row, broadcast).
    """
    stats = df.agg(*[F.avg(f).alias(f"_m_{i}") for i, f in enumerate(features)],
                   *[F.stddev_samp(f).alias(f"_s_{i}") for i, f in enumerate(features)])
    j = df.crossJoin(F.broadcast(stats))
    vals = []
    for i, f in enumerate(features):
        d = F.col(f).cast("double") - F.col(f"_m_{i}")
        vals.append(d * F.lit(weights[f]) if weights else
                    F.when(F.col(f"_s_{i}") > 0, d / F.col(f"_s_{i}")).otherwise(0.0))
    m = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*vals))
    return j.withColumn(out, m).drop(*[c for c in j.columns if c.startswith(("_m_", "_s_"))])
