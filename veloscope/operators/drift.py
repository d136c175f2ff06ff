"""Distribution drift between a reference and a current table.

Numeric columns are unpivoted to (feature, x) so that every statistic is one
grouped aggregate over all features at once. Per-feature profiles are one row
per feature (size bounded by the number of columns) and broadcast; the
two-sample KS statistic uses the running totals of ``prefix`` so a
feature holding all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.functions.columns import round_to
from veloscope.operators.prefix import quantiles_of, running_sums
from veloscope.session import written_once

EPS = 1e-8


def long_format(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, x) rows, nulls dropped."""
    cols = [F.col(f).cast("double").alias(f) for f in features]
    return (df.select(*cols).unpivot([], list(features), "feature", "x").where(F.col("x").isNotNull()))


def long_sides(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, x, side) of rows that carry ``side``; rows without a side are in neither."""
    cols = [F.col(f).cast("double").alias(f) for f in features]
    return df.where(F.col("side").isNotNull()).select("side", *cols) \
             .unpivot(["side"], list(features), "feature", "x").where(F.col("x").isNotNull())


def value_table(long: DataFrame) -> DataFrame:
    """One row per (feature, x) of ``long`` (feature, x, side 0 reference / 1 current): how often each side has the
    value (a, b), its running and total counts. Written once; every statistic below reads this table only."""
    pts = long.groupBy("feature", "x").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    return written_once(running_sums(pts, ["feature"], "x", ["a", "b"]), "drift-values")


def reference_profile(ref_long: DataFrame, n_bins: int = K.DRIFT_BINS) -> DataFrame:
    """Mean, sample std, min, max, p10..p90 (linear) and n_bins+1 equal-width edges per feature."""
    return profile_of(value_table(ref_long.withColumn("side", F.lit(0))), n_bins)


def profile_of(values: DataFrame, n_bins: int = K.DRIFT_BINS) -> DataFrame:
    """J1 from the value table's reference side.

    Edges follow linspace(min, max): e_i = i * step + min with e_last = max; a
    constant column gets edges over [min - 0.5, max + 0.5].
    """
    pct = list(K.DRIFT_PERCENTILES)
    ref = values.where("a > 0")
    m = ref.groupBy("feature").agg(F.sum("a").alias("n_ref"), (F.sum(F.col("a") * F.col("x")) / F.sum("a")).alias("mean"),
                                   F.min("x").alias("min"), F.max("x").alias("max"))
    # a row per feature
    dev = ref.join(F.broadcast(m.select("feature", "mean")), "feature").groupBy("feature").agg(
        F.sum(F.col("a") * F.pow(F.col("x") - F.col("mean"), 2)).alias("_ss"))
    moments = m.join(dev, "feature").withColumn("std", F.when(F.col("n_ref") > 1, F.sqrt(F.col("_ss") / (F.col("n_ref") - 1)))).drop("_ss")
    qv = quantiles_of(ref.select("feature", F.col("x").alias("_v"), F.col("a").alias("_c"), F.col("run_a").alias("run__c"),
                                 F.col("tot_a").alias("tot__c")), ["feature"], pct)
    prof = moments.join(qv.select("feature", F.array(*[f"q{i}" for i in range(len(pct))]).alias("percentiles")),
                        "feature", "inner")
    const = F.col("min") == F.col("max")
    lo = F.when(const, F.col("min") - 0.5).otherwise(F.col("min"))
    hi = F.when(const, F.col("max") + 0.5).otherwise(F.col("max"))
    step = (hi - lo) / n_bins
    edges = F.array(*[lo + F.lit(float(i)) * step for i in range(n_bins)], hi)
    return prof.withColumn("edges", edges)


def bin_index(x: Column, edges: Column, n_bins: int = K.DRIFT_BINS) -> Column:
    """Histogram bin of x ([e_i, e_i+1), last bin closed); null when outside the edges."""
    inner = F.slice(edges, 2, n_bins - 1)
    idx = F.size(F.filter(inner, lambda e: x >= e))
    return F.when((x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, n_bins + 1)), idx)


def histograms(values: DataFrame, prof: DataFrame, n_bins: int) -> DataFrame:
    """J2 for both sides: (feature, bin, h_ref, h_cur) over the reference edges; a row per bin that has values."""
    b = values.join(F.broadcast(prof.select("feature", "edges")), "feature", "inner") \
              .withColumn("bin", bin_index(F.col("x"), F.col("edges"), n_bins)).where(F.col("bin").isNotNull())
    return b.groupBy("feature", "bin").agg(F.sum("a").alias("h_ref"), F.sum("b").alias("h_cur"))


def ks_two_sample(values: DataFrame) -> DataFrame:
    """Max |F_ref(x) - F_cur(x)| over all observed x, per feature, from the value table."""
    diff = F.abs(F.try_divide(F.col("run_a"), F.col("tot_a")) - F.try_divide(F.col("run_b"), F.col("tot_b")))
    return values.groupBy("feature").agg(F.max(diff).alias("ks_statistic"), F.first("tot_a").alias("n_ref_ks"),
                                         F.first("tot_b").alias("n_cur"))


def ks_pvalue(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value, Q(lambda) = 2 sum (-1)^(k-1) exp(-2 k^2 lambda^2).

    lambda = D sqrt(n m / (n + m)); p = 1 for lambda < 0.2 (the series needs
    many terms there and Q is 1 to double precision); clipped to [0, 1].
    An approximation of the exact small-sample distribution.
    """
    lam = d * F.sqrt(n * m / (n + m))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))


def exact_pvalue(n: int, m: int, gap: int) -> float:
    """P(max |i m - j n| >= gap) over all equally likely orders of n reference and m current values (lattice paths).

    ``u[i]`` is the probability that a path to (i, k - i) has stayed inside; one step of k is a vector operation.
    """
    if gap <= 0:
        return 1.0
    i = np.arange(n + 1)
    u = np.zeros(n + 1)
    u[0] = 1.0
    for k in range(1, n + m + 1):
        j = k - i
        step = u * (j / k)
        step[1:] += u[:-1] * (i[1:] / k)
        u = np.where((j >= 0) & (j <= m) & (np.abs(i * m - j * n) < gap), step, 0.0)
    return float(min(max(1.0 - u[n], 0.0), 1.0))


def ks_test(values: DataFrame, exact_up_to: int = K.KS_EXACT_SAMPLES) -> DataFrame:
    """J4, J5 with scipy's ``auto`` rule: (feature, ks_statistic, n_ref, n_cur, ks_pvalue), exact where neither sample has more
    than ``exact_up_to`` values, asymptotic beyond.

    The statistic is kept as a whole number, max |run_ref * n_cur - run_cur * n_ref|, so equal differences compare equal.
    Ties: the statistic is read at distinct values only, the distribution is that of samples without ties (p is conservative).
    """
    gap = F.max(F.abs(F.col("run_a") * F.col("tot_b") - F.col("run_b") * F.col("tot_a")))
    rows = values.where("tot_a > 0 AND tot_b > 0").groupBy("feature").agg(
        gap.alias("gap"), F.first("tot_a").alias("n_ref"), F.first("tot_b").alias("n_cur"))
    d = F.col("gap") / (F.col("n_ref") * F.col("n_cur"))
    rows = rows.withColumns({"ks_statistic": d, "far": ks_pvalue(d, F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))})

    def run(batches):
        for b in batches:
            p = [far if max(n, m) > exact_up_to else exact_pvalue(n, m, gap)
                 for n, m, gap, far in zip(*(b.column(c).to_pylist() for c in ("n_ref", "n_cur", "gap", "far")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("feature", "ks_statistic", "n_ref", "n_cur")), pa.array(p, pa.float64())],
                                             ["feature", "ks_statistic", "n_ref", "n_cur", "ks_pvalue"])

    return rows.mapInArrow(run, "feature string, ks_statistic double, n_ref long, n_cur long, ks_pvalue double")


def drift_report(ref: DataFrame, cur: DataFrame, features: Sequence[str], n_bins: int = K.DRIFT_BINS,
                 psi_threshold: float = K.PSI_THRESHOLD, p_threshold: float = K.KS_PVALUE_THRESHOLD,
                 min_current: int = K.DRIFT_MIN_CURRENT, p_value: str = "asymptotic") -> tuple[DataFrame, DataFrame]:
    """(per-feature rows, one summary row). ``p_value``: "asymptotic", or "auto": exact for small samples (``ks_test``).

    Features with fewer than ``min_current`` non-null current values are
    skipped (no row) but counted as checked. Reported values are rounded to 4
    places; the verdict uses the unrounded ones.
    """
    both = long_format(ref, features).withColumn("side", F.lit(0)).unionByName(
        long_format(cur, features).withColumn("side", F.lit(1)))
    return drift_of(both, features, n_bins, psi_threshold, p_threshold, min_current, p_value)


def drift_of(long: DataFrame, features: Sequence[str], n_bins: int = K.DRIFT_BINS,
             psi_threshold: float = K.PSI_THRESHOLD, p_threshold: float = K.KS_PVALUE_THRESHOLD,
             min_current: int = K.DRIFT_MIN_CURRENT, p_value: str = "asymptotic") -> tuple[DataFrame, DataFrame]:
    """``drift_report`` of rows that carry their side: (feature, x, side)."""
    values = value_table(long)
    prof = profile_of(values, n_bins)
    grid = prof.select("feature", "edges", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    g = grid.join(histograms(values, prof, n_bins), ["feature", "bin"], "left").fillna(0, ["h_ref", "h_cur"])
    width = F.element_at("edges", F.col("bin") + 2) - F.element_at("edges", F.col("bin") + 1)
    per = g.groupBy("feature").agg(
        F.sum("h_ref").alias("_sr"), F.sum("h_cur").alias("_sc"),
        F.collect_list(F.struct("bin", "h_ref", "h_cur", width.alias("w"))).alias("_bins"))
    pr = lambda h, s: h / (s + EPS) + EPS
    psi = F.aggregate("_bins", F.lit(0.0), lambda acc, b: acc + (pr(b["h_cur"], F.col("_sc")) - pr(b["h_ref"], F.col("_sr")))
                      * F.log(pr(b["h_cur"], F.col("_sc")) / pr(b["h_ref"], F.col("_sr"))))
    # densities (+eps), normalised, then the Jensen-Shannon distance (natural log)
    dens = lambda h, s, w: F.try_divide(h, s * w) + EPS  # noqa: E731  (no current rows → null)
    sp = F.aggregate("_bins", F.lit(0.0), lambda acc, b: acc + dens(b["h_ref"], F.col("_sr"), b["w"]))
    sq = F.aggregate("_bins", F.lit(0.0), lambda acc, b: acc + dens(b["h_cur"], F.col("_sc"), b["w"]))

    def js_term(b):
        p = dens(b["h_ref"], F.col("_sr"), b["w"]) / sp
        q = dens(b["h_cur"], F.col("_sc"), b["w"]) / sq
        m = (p + q) / 2
        return p * F.log(p / m) + q * F.log(q / m)
    js = F.sqrt(F.aggregate("_bins", F.lit(0.0), lambda acc, b: acc + js_term(b)) / 2)
    per = per.select("feature", psi.alias("_psi"), F.when(F.col("_sc") > 0, js).alias("_js"))
    ks = ks_two_sample(values)
    out = per.join(ks, "feature", "inner").where(F.col("n_cur") >= min_current)
    pval = ks_pvalue(F.col("ks_statistic"), F.col("n_ref_ks").cast("double"), F.col("n_cur").cast("double"))
    if p_value == "auto":
        exact = ks_test(values).select("feature", F.col("ks_pvalue").alias("_p"))
        out = out.join(exact, "feature", "left")
    else:
        out = out.withColumn("_p", pval)
    drifted = (F.col("_psi") > psi_threshold) | (F.col("_p") < p_threshold)
    per_feature = out.select(
        "feature",
        round_to("_psi", 4).alias("psi"),
        F.when(F.col("_psi") < K.PSI_MODERATE, "stable").when(F.col("_psi") <= psi_threshold, "moderate")
         .otherwise("significant").alias("psi_band"),
        round_to("ks_statistic", 4).alias("ks_statistic"),
        round_to("_p", 4).alias("ks_pvalue"),
        round_to("_js", 4).alias("js_distance"),
        drifted.cast("int").alias("drifted"),
        F.col("n_cur").alias("n_current"))
    n_checked = len([f for f in features])
    summary = per_feature.agg(
        F.lit(n_checked).cast("long").alias("total_features_checked"),
        F.count_if(F.col("drifted") == 1).alias("drifted_feature_count"),
        F.count_if(F.col("drifted") == 0).alias("stable_feature_count"),
        F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"),
        F.coalesce(F.max("ks_statistic"), F.lit(0.0)).alias("max_ks_stat"),
    ).withColumn("drift_rate", F.col("drifted_feature_count") / F.greatest(F.col("total_features_checked"), F.lit(1))) \
     .withColumn("overall_drifted", (F.col("drifted_feature_count") > 0).cast("int"))
    return per_feature, summary


def sides_by_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Adds ``side``: 0 for the first half of the time range, 1 for the second (one min/max aggregate)."""
    mm = df.agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    mid = F.timestamp_micros(((F.unix_micros("_t0") + F.unix_micros("_t1")) / 2).cast("long"))
    j = df.crossJoin(F.broadcast(mm.select(mid.alias("_mid"))))
    return j.withColumn("side", (F.col(ts) >= F.col("_mid")).cast("int")).drop("_mid")


def split_by_time(df: DataFrame, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Reference = first half of the time range, current = second half."""
    j = sides_by_time(df, ts)
    return j.where("side = 0").drop("side"), j.where("side = 1").drop("side")


def drift_by_time(df: DataFrame, features: Sequence[str], ts: str = "timestamp", **more) -> tuple[DataFrame, DataFrame]:
    """Drift of the second half of the period against the first, in one pass over the rows."""
    return drift_of(long_sides(sides_by_time(df, ts), features), features, **more)


def trailing_reference(df: DataFrame, asof, ts: str = "timestamp", days: int = 30,
                       check_hours: int = 1) -> tuple[DataFrame, DataFrame]:
    """reference = [asof - days, asof - check window), current = the last ``check_hours``."""
    a = F.lit(asof).cast("timestamp")
    cur_start = a - F.expr(f"INTERVAL {check_hours} HOURS")
    ref = df.where((F.col(ts) >= a - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) < cur_start))
    cur = df.where((F.col(ts) >= cur_start) & (F.col(ts) < a))
    return ref, cur
