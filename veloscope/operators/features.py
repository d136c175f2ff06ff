"""Feature matrix (F0, F1, F2, F6): all raw features in one plan.

Rows of normal users share a single hash exchange on user_id: the sliding
frames, the user-level windows and the (user, category) / (user, merchant)
windows all reuse it. Rows of hot users (see ``skew.split_hot``) take the
bucketed velocity shape and get their user aggregates by groupBy + join.
Labels, ids and timestamps stay on the row, so nothing is re-joined by id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators import behavioral as B
from veloscope.operators import point_in_time as P
from veloscope.operators import temporal as T
from veloscope.operators import transaction as X
from veloscope.functions import columns as C
from veloscope.operators.prefix import exact_quantiles
from veloscope.operators.profile import JOIN, OVER, attach, grouped, over_columns
from veloscope.operators.skew import DEFAULT_HOT_ROWS, NULL_SALT, dealt, split_hot
from veloscope.session import written_alone, written_once

RID = "_rid"

ALL_GROUPS = ("calendar", "velocity", "recency", "behavioral", "transaction", "geo", "device")

CALENDAR = ["hour_of_day", "day_of_week", "is_night", "is_weekend", "day_of_month"]
RECENCY = ["days_since_first_txn", "seconds_since_last_txn"]
BEHAVIORAL = ["amount_vs_user_avg", "amount_vs_user_median", "user_night_txn_ratio",
              "user_total_spend", "user_txn_count", "category_frequency_ratio",
              "is_new_category", "spend_percentile", "avg_daily_spend"]
TRANSACTION = ["amount_zscore", "is_round_amount", "is_large_amount", "is_new_merchant",
               "merchant_risk_proxy"]
GEO = ["country", "is_international", "high_risk_country", "latitude", "longitude"]
DEVICE = ["card_not_present", "unique_devices_per_user", "has_device_fingerprint"]
BASE = ["amount", "currency", "merchant_category"]
ID_COLUMNS = ["transaction_id", "user_id", "merchant_id", "timestamp", "is_fraud"]


def velocity_names(windows: Sequence[int] = K.VELOCITY_WINDOWS_HOURS) -> list[str]:
    return [f"{p}_{h}h" for h in windows
            for p in ("txn_count", "amount_sum", "amount_max", "unique_merchants")]


def feature_names(windows: Sequence[int] = K.VELOCITY_WINDOWS_HOURS,
                  groups: Sequence[str] = ALL_GROUPS) -> list[str]:
    """Ordered model feature names (48 with the default windows and all groups)."""
    by_group = {"calendar": CALENDAR, "velocity": velocity_names(windows), "recency": RECENCY,
                "behavioral": BEHAVIORAL, "transaction": TRANSACTION, "geo": GEO, "device": DEVICE}
    return BASE + [n for g in ALL_GROUPS if g in groups for n in by_group[g]]


def _derive(df: DataFrame, groups: Sequence[str], how: str, windows: Sequence[int], mode: str = "full", n_rows: int = 0,
            profile: bool = False, percentile: bool = False) -> DataFrame:
    """Three projections on the normal path: inputs, every window column, derived features.

    (Each DataFrame transformation re-analyses the plan; keeping the window
    columns in one projection keeps plan building cheap.) ``profile``: the point-in-time profile is still to be computed, by windows;
    ``percentile``: the spend percentile without the rest of its group.
    """
    percentile = percentile or "behavioral" in groups
    if profile:
        df = df.withColumn(P.RID, F.monotonically_increasing_id())
    df = T.salted(df.withColumns({T.US: C.micros("timestamp"), **T.calendar_columns()}), "user_id")
    # point in time, the profile columns are on the rows already, or ``profile`` adds them
    full = mode == "full"
    needs_user = full and bool({"behavioral", "transaction", "device"} & set(groups))
    if how == OVER:
        cols = {}
        if "velocity" in groups or "recency" in groups:
            cols.update(T.velocity_columns(T._range_frame(["user_id", NULL_SALT]), windows, "user_id"))
            cols.update(T.recency_columns())
        if needs_user:
            cols.update(over_columns(["user_id"], B.user_aggs(df), [NULL_SALT]))
        if "behavioral" in groups:
            if full and "merchant_category" in df.columns:
                cols.update(over_columns(["user_id", "merchant_category"], {"_uc_count": F.count(F.lit(1))}, [NULL_SALT]))
        if percentile:
            cols.update(B.spend_percentile_columns())
        if full and "transaction" in groups:
            cols.update(over_columns(["user_id", "merchant_id"], {"_um_count": F.count(F.lit(1))}, [NULL_SALT]))
        df = dealt(df, n_rows, "user_id", NULL_SALT) if cols or profile else df
        df = (P.plain_profile(df, [NULL_SALT]) if profile else df).withColumns(cols)
    else:
        # hot users: every group is computed from narrow rows of one written table; the results, each written alone,
        # meet the wide rows in joins by row, so these are shuffled once
        base = written_once(df.withColumn(RID, F.monotonically_increasing_id()), "rows")
        df = base
        if "velocity" in groups or "recency" in groups:
            narrow = base.select(RID, "user_id", "transaction_id", T.US, "amount", "merchant_id")
            names = velocity_names(windows) + RECENCY
            df = df.join(written_alone(lambda: T.bucketed_velocity_recency(narrow, windows).select(RID, *names), "velocity"), RID, "left")
        if needs_user:
            df = df.join(written_alone(lambda: _user_columns(base, groups), "profile"), RID, "left")
        if percentile:
            rows = base.select(RID, "user_id", "transaction_id", T.US, "amount")
            df = df.join(written_alone(lambda: B.spend_percentile_distributed(rows).select(RID, "spend_percentile"), "percentile"), RID, "left")
    derived = {}
    if "behavioral" in groups:
        derived.update(B.behavioral_columns(df, mode))
    if "transaction" in groups:
        derived.update(X.transaction_columns(df, mode))
    if "geo" in groups:
        derived.update(X.geo_columns(df))
    if "device" in groups:
        derived.update(X.device_columns(df))
    return df.withColumns(derived) if derived else df


def _user_columns(base: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(RID, the user's aggregates over the whole table and the counts with the row's category and merchant), joined to narrow rows."""
    keys = [k for k in ("user_id", "merchant_category", "merchant_id") if k in base.columns]
    df = base.select(RID, *keys)
    if "transaction" in groups:
        df = attach(df, ["user_id", "merchant_id"], {"_um_count": F.count(F.lit(1))}, JOIN, source=base).drop("merchant_id")
    if "behavioral" in groups and "merchant_category" in keys:
        df = attach(df, ["user_id", "merchant_category"], {"_uc_count": F.count(F.lit(1))}, JOIN, source=base)
    df = df.drop("merchant_category", "merchant_id")
    aggs = B.user_aggs(base)
    aggs.pop("_u_median")
    users = written_once(base.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(*grouped(aggs)), "users")
    med = written_alone(lambda: exact_quantiles(base, ["user_id"], "amount", [0.5], prefix="_u_median")
                        .select("user_id", F.col("_u_median0").alias("_u_median")), "medians")
    return df.join(users, "user_id", "left").join(med, "user_id", "left").drop("user_id")


STRING_FEATURES = {"currency", "merchant_category", "country"}


def compute_features(df: DataFrame, groups: Sequence[str] = ALL_GROUPS,
                     windows: Sequence[int] = K.VELOCITY_WINDOWS_HOURS,
                     hot_threshold: int | None = DEFAULT_HOT_ROWS,
                     keep: Sequence[str] = (), fill_zero: bool = False, finish=None, mode: str = "full") -> DataFrame:
    """Raw (un-encoded) feature rows: ids + label + the selected feature groups.

    ``hot_threshold``: users with more rows take the bucketed shape
    (``0`` routes every user there, ``None`` disables detection; a point-in-time
    profile of more than ``point_in_time.PLAIN_ROWS`` rows is distributed all the same).
    ``mode``: profile features over the user's whole table ("full") or over the earlier rows ("point_in_time").
    ``fill_zero`` fills numeric feature nulls with 0 and ``finish(name, column)``
    may wrap each output column (casts, rounding) -- both inside the one final
    projection, so no extra DataFrame step is planned on top of the windows.
    ``spend_percentile`` in ``keep`` is computed without the other behavioural features.
    """
    present_ids = [c for c in ID_COLUMNS if c in df.columns]
    names = [n for n in feature_names(windows, groups) if n in BASE and n in df.columns or n not in BASE]
    if mode not in ("full", "point_in_time"):
        raise ValueError(f"unknown mode {mode!r}")
    profile = mode == "point_in_time" and bool({"behavioral", "transaction", "device"} & set(groups))
    # the plain profile sorts a user's earlier amounts at every row: its bound holds without detection, too
    plain = min(P.PLAIN_ROWS if hot_threshold is None else hot_threshold, P.PLAIN_ROWS) if profile else hot_threshold
    split = split_hot(df, ["user_id"], plain)
    pct = "spend_percentile" in keep
    parts = [_derive(split.normal, groups, OVER, windows, mode, split.n_rows, profile, pct)]
    if split.hot is not None and profile:
        # users above the bound of the plain profile; those above the hot threshold take the bucketed shape of the rest, too
        larger = split_hot(P.point_in_time_profile(split.hot), ["user_id"], hot_threshold, counted=split.hot)
        if larger.n_hot_keys < split.n_hot_keys:
            parts.append(_derive(larger.normal, groups, OVER, windows, mode, larger.n_rows, percentile=pct))
        split = larger
    if split.hot is not None:
        parts.append(_derive(split.hot, groups, JOIN, windows, mode, percentile=pct))
    cols = present_ids + [n for n in names if n not in present_ids] + [k for k in keep if k not in names]

    def out(c):
        e = F.col(c)
        if fill_zero and c in names and c not in STRING_FEATURES and c not in ID_COLUMNS:
            e = F.coalesce(e, F.lit(0))
        return (finish(c, e) if finish else e).alias(c)
    return reduce(DataFrame.unionByName, [p.select(*[out(c) for c in cols]) for p in parts])


def feature_matrix(df: DataFrame, **kw) -> DataFrame:
    """F0 + F6: the 48-column matrix with ids/label kept, numeric nulls filled with 0."""
    return compute_features(df, fill_zero=True, **kw)
