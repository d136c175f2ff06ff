"""Registered data-quality and source queries (A11, A13, B1-B15) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from veloscope import constants as K
from veloscope.operators import quality as Q
from veloscope.plans.common import Query, project, registry, sql_select
from veloscope.sources import events as EV
from veloscope.sources.transactions import SOURCES

REPORT = {"passed": "l", "n_rows": "l", "n_rows_valid": "l", "n_rows_clean": "l", "errors": "s",
          "warnings": "s", "n_null_txn_id": "l", "n_null_user_id": "l", "n_bad_amount": "l",
          "n_null_amount": "l", "n_duplicate_ids": "l", "fraud_rate": "d"}


def report_sql(source: str) -> str:
    lo, hi = K.MIN_AMOUNT, K.MAX_AMOUNT
    return f"""WITH {SOURCES[source][1]},
a AS (SELECT count(*) AS n_rows,
             count(*) FILTER (WHERE transaction_id IS NULL) AS n_null_txn_id,
             count(*) FILTER (WHERE user_id IS NULL) AS n_null_user_id,
             count(*) FILTER (WHERE amount < {lo} OR amount > {hi}) AS n_bad_amount,
             count(*) FILTER (WHERE amount IS NULL) AS n_null_amount,
             count(DISTINCT transaction_id) AS n_distinct_ids,
             count(*) FILTER (WHERE transaction_id IS NOT NULL AND amount BETWEEN {lo} AND {hi}) AS n_rows_clean,
             avg(is_fraud) AS fraud_rate,
             count(*) FILTER (WHERE is_fraud IS NULL) AS n_null_label
      FROM txn),
b AS (SELECT *, n_rows - n_distinct_ids - CASE WHEN n_null_txn_id > 0 THEN 1 ELSE 0 END AS n_duplicate_ids,
             concat_ws('; ',
               CASE WHEN n_null_txn_id > 0 THEN printf('transaction_id: %d null', n_null_txn_id) END,
               CASE WHEN n_null_user_id > 0 THEN printf('user_id: %d null', n_null_user_id) END,
               CASE WHEN n_bad_amount > 0 THEN printf('amount: %d not within {lo} and {hi:.1f}',
                                                     n_bad_amount) END,
               CASE WHEN n_null_amount > 0 THEN printf('amount: %d null', n_null_amount) END,
               CASE WHEN n_null_label > 0 THEN printf('is_fraud: %d null', n_null_label) END)
               AS errors
      FROM a),
c AS (SELECT *, CAST(errors = '' AS INTEGER) AS passed,
             greatest(0, n_rows - n_null_txn_id - n_bad_amount) AS n_rows_valid,
             concat_ws('; ',
               CASE WHEN n_duplicate_ids > 0 THEN printf('transaction_id: %d repeated', n_duplicate_ids) END,
               CASE WHEN fraud_rate < {K.MIN_FRAUD_RATE} THEN printf('is_fraud: only %.4f%% positive', fraud_rate * 100) END,
               CASE WHEN fraud_rate > {K.MAX_FRAUD_RATE} THEN printf('is_fraud: as much as %.2f%% positive', fraud_rate * 100) END)
               AS warnings
      FROM b)
SELECT {sql_select(REPORT)} FROM c"""


def _report(source):
    def run(spark, sf_dir):
        return project(Q.validation_report(SOURCES[source][0](spark, sf_dir)), REPORT)
    return Query(f"quality_report_{source}", run, report_sql(source), "B1-B11 validation report")


CONTRACT = {"transaction_id": "l", "accepted": "l", "contract_errors": "s", "currency": "s",
            "merchant_category": "s", "payment_method": "s", "country": "s"}


def _contract_run(spark, sf_dir):
    txn = SOURCES["orders"][0](spark, sf_dir)
    flat = EV.flatten_event(EV.to_nested(txn))
    checked = Q.normalize_event(flat)
    checked = checked.withColumn("_e", Q.contract_errors(checked))
    out = checked.withColumns({"accepted": (F.size("_e") == 0).cast("int"),
                               "contract_errors": F.array_join("_e", "; ")})
    return project(out, CONTRACT)


def _contract_sql():
    cats = ", ".join(f"'{c}'" for c in K.MERCHANT_CATEGORIES)
    pms = ", ".join(f"'{c}'" for c in K.PAYMENT_METHODS)
    return f"""WITH {SOURCES['orders'][1]},
f AS (SELECT transaction_id, user_id, amount, upper(coalesce(currency, 'USD')) AS currency, merchant_id,
             coalesce(merchant_category, 'other') AS merchant_category,
             coalesce(payment_method, 'credit_card') AS payment_method,
             upper(coalesce(country, '{K.HOME_COUNTRY}')) AS country
      FROM txn),
e AS (SELECT *, concat_ws('; ',
        CASE WHEN transaction_id IS NULL OR length(CAST(transaction_id AS VARCHAR)) NOT BETWEEN 1 AND 100
             THEN 'transaction_id length' END,
        CASE WHEN user_id IS NULL OR length(CAST(user_id AS VARCHAR)) NOT BETWEEN 1 AND 100 THEN 'user_id length' END,
        CASE WHEN amount IS NULL OR NOT (amount > 0) OR NOT (amount <= {K.MAX_AMOUNT}) THEN 'amount range' END,
        CASE WHEN length(currency) <> 3 THEN 'currency length' END,
        CASE WHEN merchant_id IS NULL OR length(merchant_id) NOT BETWEEN 1 AND 100 THEN 'merchant_id length' END,
        CASE WHEN merchant_category NOT IN ({cats}) THEN 'merchant_category enum' END,
        CASE WHEN payment_method NOT IN ({pms}) THEN 'payment_method enum' END,
        CASE WHEN country IS NOT NULL AND length(country) NOT BETWEEN 2 AND 3 THEN 'country length' END)
        AS contract_errors FROM f)
SELECT {sql_select({**CONTRACT, 'accepted': 'l'})} FROM (SELECT *, CAST(contract_errors = '' AS INTEGER) AS accepted FROM e)"""


TRAIN = {"n_rows": "l", "n_fraud": "l", "required_rows": "l", "required_fraud": "l", "passed": "l", "reason": "s"}


def _train_sql(source):
    return f"""WITH {SOURCES[source][1]},
a AS (SELECT count(*) AS n_rows, CAST(sum(is_fraud) AS BIGINT) AS n_fraud FROM txn),
b AS (SELECT *, {K.MIN_TRAINING_ROWS} AS required_rows, {K.MIN_TRAINING_FRAUD} AS required_fraud,
             CASE WHEN n_rows < {K.MIN_TRAINING_ROWS} THEN printf('need at least {K.MIN_TRAINING_ROWS} rows, got %d', n_rows)
                  WHEN coalesce(n_fraud, 0) < {K.MIN_TRAINING_FRAUD}
                  THEN printf('need at least {K.MIN_TRAINING_FRAUD} fraud rows, got %d', coalesce(n_fraud, 0)) END AS r
      FROM a)
SELECT {sql_select(TRAIN)} FROM (SELECT *, CAST(r IS NULL AS INTEGER) AS passed, coalesce(r, '') AS reason FROM b)"""


def _train(source):
    def run(spark, sf_dir):
        return project(Q.training_requirements(SOURCES[source][0](spark, sf_dir)), TRAIN)
    return Query(f"training_requirements_{source}", run, _train_sql(source), "B14")


SAMPLE = {"transaction_id": "l", "user_id": "l", "amount": "d"}


def _sample_run(spark, sf_dir):
    return project(EV.sample_exact(SOURCES["orders"][0](spark, sf_dir), 1000), SAMPLE)


def build():
    return registry(
        _report("events"), _report("orders"), _report("lineitem"),
        Query("event_contract_orders", _contract_run, _contract_sql(), "A11 flatten + B12/B13 contract"),
        _train("events"), _train("orders"),
        Query("sample_exact_orders", _sample_run,
              f"""WITH {SOURCES['orders'][1]}
SELECT {sql_select(SAMPLE)} FROM txn
ORDER BY CAST('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || '|{K.SPLIT_SEED}'), 1, 15) AS BIGINT),
         transaction_id LIMIT 1000""", "A13 exact-n seeded sample (md5 order)"),
    )
