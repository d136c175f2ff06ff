"""Fixed values that results depend on (thresholds, lists, windows).

Every value below is a fixed parameter of the transaction-risk semantics and
is stated here once, in natural order; operators take them as defaults.
"""

from __future__ import annotations

# ---- fixed values: velocity windows (hours) -------------------------------
VELOCITY_WINDOWS_HOURS = (1, 6, 24, 168)

# ---- fixed values: transaction features -----------------------------------
ROUND_AMOUNT_MODULUS = 100.0
LARGE_AMOUNT = 1000.0
HIGH_RISK_CATEGORIES = ("online_gambling", "electronics", "jewelry")
HIGH_RISK_COUNTRIES = ("NG", "RU", "CN", "KP", "IR", "BY")
HOME_COUNTRY = "US"
RATIO_EPS = 1e-8

# ---- fixed values: data-quality bounds --------------------------------------
MIN_AMOUNT = 0.01
MAX_AMOUNT = 1_000_000.0
MIN_FRAUD_RATE = 0.001
MAX_FRAUD_RATE = 0.20
REQUIRED_COLUMNS = ("transaction_id", "user_id", "amount", "currency",
                    "merchant_id", "merchant_category", "timestamp")
MIN_TRAINING_ROWS = 10_000
MIN_TRAINING_FRAUD = 100

# ---- fixed values: event contract enums -------------------------------------
RISK_TIERS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
PAYMENT_METHODS = ("credit_card", "debit_card", "digital_wallet", "bank_transfer",
                   "bnpl", "crypto", "other")
MERCHANT_CATEGORIES = ("electronics", "groceries", "restaurants", "travel", "online_gambling",
                       "jewelry", "financial_services", "healthcare", "entertainment", "other")

# ---- fixed values: scoring ---------------------------------------------------
TIER_CRITICAL = 0.85
TIER_HIGH = 0.60
TIER_MEDIUM = 0.30
DECISION_BLOCK = 0.85
DECISION_REVIEW = 0.35
FRAUD_LABEL_THRESHOLD = 0.5
ENSEMBLE_WEIGHTS = (0.55, 0.45)
# contribution buckets, checked in this order; the first matching rule wins.
# (bucket, substrings, combine) -- combine "max" keeps the largest |value|,
# "last" keeps the value of the last matching feature in column order.
CONTRIBUTION_BUCKETS = (
    ("velocity_1h", ("velocity_1h", "txn_count_1h"), "max"),
    ("velocity_24h", ("velocity_24h", "txn_count_24h"), "max"),
    ("amount_zscore", ("amount_zscore",), "last"),
    ("new_device", ("device",), "max"),
    ("geo_anomaly", ("country", "geo", "international"), "max"),
    ("merchant_risk_score", ("merchant_risk",), "last"),
    ("time_of_day_anomaly", ("is_night", "hour"), "max"),
    ("card_not_present", ("card_not_present",), "last"),
)

# ---- fixed values: evaluation ------------------------------------------------
RECALL_TARGETS = (0.80, 0.85, 0.90, 0.95, 0.99)
CATCH_RATE_PCTS = (1, 5, 10, 20)
THRESHOLD_GRID = (0.1, 0.95, 20)  # linspace(start, stop, n)
PROB_CLIP = 2.220446049250313e-16

# ---- fixed values: drift -------------------------------------------------------
DRIFT_BINS = 10
PSI_THRESHOLD = 0.25
PSI_MODERATE = 0.10
KS_PVALUE_THRESHOLD = 0.05
KS_EXACT_SAMPLES = 10_000      # larger samples get the asymptotic p-value
DRIFT_MIN_CURRENT = 30
DRIFT_PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90)
DRIFT_CRITICAL_PSI = 0.40

# ---- fixed values: monitoring ----------------------------------------------------
LATENCY_BUCKETS_MS = (5, 10, 20, 30, 50, 75, 100, 150, 200, 500)
PROBABILITY_BUCKETS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
STORE_LATENCY_BUCKETS_MS = (1, 2, 5, 10, 20, 50)
BATCH_SIZE_BUCKETS = (1, 10, 50, 100, 250, 500, 1000)
LATENCY_P99_SLA_MS = 200.0
ERROR_RATE_MAX = 0.01
FRAUD_RATE_Z_ALERT = 3.0
FRAUD_RATE_Z_CRITICAL = 4.0
PERF_DROP_CRITICAL_PCT = 10.0

# ---- fixed values: store --------------------------------------------------------
STORE_TTL_SECONDS = 3600
STORE_TTL_LONG_SECONDS = 86400
VELOCITY_COUNTER_MINUTES = (60, 360, 1440, 10080)

# ---- fixed values: training / backtest ---------------------------------------------
SPLIT_SEED = 42
TEST_SIZE = 0.15
VAL_SIZE = 0.15
CV_FOLDS = 5
BACKTEST_TRAIN_DAYS = 180
BACKTEST_TEST_DAYS = 30
BACKTEST_STEP_DAYS = 30
BACKTEST_MIN_TRAIN_FRAUD = 50
BACKTEST_MIN_TEST_FRAUD = 5
BACKTEST_MIN_TRAIN_ROWS = 1000
BACKTEST_STABLE_STD = 0.05
REGISTER_MIN_AUC_PR = 0.85
FAIL_BELOW_AUC_PR = 0.70
OVERSAMPLE_RATIO = 0.15

# ---- fixed values: rule-based risk prior (E13) ---------------------------------
PRIOR_BASE_RATE = 0.022
PRIOR_MERCHANT_RATES = (
    ("electronics", 0.055), ("online_gambling", 0.078), ("jewelry", 0.062),
    ("travel", 0.041), ("financial_services", 0.038), ("restaurants", 0.012),
    ("groceries", 0.008), ("healthcare", 0.009), ("entertainment", 0.022),
    ("other", 0.018),
)
PRIOR_MERCHANT_DEFAULT = 0.02
PRIOR_HIGH_RISK_COUNTRIES = ("NG", "RU", "KP", "IR", "BY", "VE")
PRIOR_MEDIUM_RISK_COUNTRIES = ("CN", "UA", "VN", "PH", "ID")
PRIOR_COUNTRY_RATES = (0.08, 0.04, 0.01)  # high, medium, other
PRIOR_WEIGHTS = (0.3, 0.4, 0.3)  # base rate, merchant rate, country rate
PRIOR_ADDONS = (("card_not_present", 0.01), ("night", 0.015),
                ("amount_gt_2000", 0.02), ("amount_gt_5000", 0.03))
PRIOR_CLIP = (0.001, 0.95)
