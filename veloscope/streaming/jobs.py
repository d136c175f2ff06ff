"""Structured Streaming jobs.

* ``scoring_stream``: messages → parse → contract → score → sinks for predictions, alerts
  (HIGH/CRITICAL), rejects and dead letters, in one ``foreachBatch`` (all writes are keyed
  by the batch id, so a replayed batch overwrites its own output: at-least-once input,
  idempotent output).
* ``velocity_counter_stream``: the TTL-refreshed counter as keyed state
  (``applyInPandasWithState``); state expires with the event-time watermark.
* ``rolling_fraud_rate_stream``: watermark + sliding event-time window.
* ``dedupe_stream``: ``dropDuplicatesWithinWatermark`` on transaction_id.
* ``store_upsert_batch``: ``foreachBatch`` upsert of the user-feature table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veloscope import constants as K
from veloscope.functions import columns as C
from veloscope.operators import quality as Q
from veloscope.operators import scoring as S
from veloscope.operators import store as ST
from veloscope.sources.events import flatten_event
from veloscope.streaming.sources import dead_letters, good_events, parse_events


def rule_score(events: DataFrame, epoch: int = 0) -> DataFrame:
    """The stand-in scorer when no model is attached: the rescaled amount."""
    return events.withColumn("fraud_probability", C.round_to(F.least(F.col("amount") / 500.0, F.lit(1.0)), 2))


def contract_and_score(events: DataFrame, scorer=rule_score, model_version: str = "rule-v1",
                       epoch: int = 0) -> tuple[DataFrame, DataFrame]:
    """H10 core: (scored rows of the events that keep the contract, rejected events with their violations).

    ``scorer(events, epoch)`` adds ``fraud_probability``.
    """
    ok, bad = Q.contract_split(flatten_event(events))
    return S.score_batch(scorer(ok, epoch), "fraud_probability", model_version, keep=("user_id", "timestamp", "amount")), bad


SINKS = ("predictions", "alerts", "rejects", "dead_letters")


def write_sinks(raw: DataFrame, epoch: int, out_dir: str, scorer=rule_score, model_version: str = "rule-v1") -> None:
    """A8-A10 sinks of one micro-batch of raw messages, each keyed by the epoch (a replay overwrites itself).

    Three sinks and the scorer read the parsed batch: it is parsed once and kept, on disk where memory is short, until they are written.
    """
    parsed = parse_events(raw).persist()
    try:
        scored, bad = contract_and_score(good_events(parsed), scorer, model_version, epoch)
        at = lambda sink: f"{out_dir}/{sink}/epoch={epoch}"
        scored.write.mode("overwrite").parquet(at("predictions"))
        # the alerts are a part of what was written, read back: the batch is scored once
        scored.sparkSession.read.schema(scored.schema).parquet(at("predictions")).where(
            F.col("risk_tier").isin("HIGH", "CRITICAL")).write.mode("overwrite").parquet(at("alerts"))
        bad.withColumn("contract_errors", F.array_join("contract_errors", "; ")).select(
            "transaction_id", "user_id", "amount", "timestamp", "contract_errors").write.mode("overwrite").parquet(at("rejects"))
        dead_letters(parsed).write.mode("overwrite").parquet(at("dead_letters"))
    finally:
        parsed.unpersist()


def scoring_stream(raw: DataFrame, out_dir: str, checkpoint: str, scorer=rule_score, model_version: str = "rule-v1",
                   trigger_available_now: bool = True):
    """Start the scoring query on raw messages (column ``value``); returns the StreamingQuery."""
    w = (raw.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, e: write_sinks(b, e, out_dir, scorer, model_version)))
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """A9/A10 (Kafka form): rows as JSON values (needs the Kafka connector)."""
    return (df.select(F.to_json(F.struct(*df.columns)).alias("value")).writeStream.format("kafka")
              .option("kafka.bootstrap.servers", servers).option("topic", topic)
              .option("checkpointLocation", checkpoint).start())


# ---------------------------------------------------------------------------
# TTL-refreshed velocity counters as keyed state
# ---------------------------------------------------------------------------

def _counter_fn(windows: Sequence[int]):
    gaps = np.array([m * 60 * 1_000_000 for m in windows], np.int64)[:, None]
    names = [f"counter_{m}m" for m in windows]
    max_gap_ms = int(gaps.max()) // 1000

    def in_order(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """A user's rows in (time, id) order and their times; ids are compared at equal times only."""
        us = pdf["_us"].to_numpy()
        order = np.argsort(us, kind="stable")
        us = us[order]
        if (us[1:] == us[:-1]).any():
            pdf = pdf.sort_values(["_us", "transaction_id"], kind="stable")
            return pdf, pdf["_us"].to_numpy()
        return pdf.take(order), us

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdfs = list(pdfs)
        pdf = pdfs[0] if len(pdfs) == 1 else pd.concat(pdfs, ignore_index=True)
        if pdf.empty:
            return
        pdf, us = in_order(pdf)
        if state.exists:
            last, *counts = state.get
        else:
            last, counts = None, [0] * len(names)
        # the time of a user never runs backwards: a late event belongs to the open session
        prev = np.empty_like(us)
        prev[0] = us[0] if last is None else last
        np.maximum(us[:-1], prev[0], out=prev[1:])
        start = us - prev >= gaps                   # a row per window
        start[:, 0] |= last is None
        idx = np.arange(len(us))
        first = np.maximum.accumulate(np.where(start, idx, -1), axis=1)
        count = np.where(first >= 0, idx - first + 1, idx + 1 + np.array(counts, np.int64)[:, None])
        newest = int(us[-1]) if last is None else max(int(us[-1]), last)
        state.update((newest, *count[:, -1].tolist()))
        state.setTimeoutTimestamp(newest // 1000 + max_gap_ms)
        yield pd.DataFrame({"transaction_id": pdf["transaction_id"].to_numpy(), "user_id": pdf["user_id"].to_numpy(),
                            **dict(zip(names, count))}, copy=False)

    return fn


def velocity_counter_stream(events: DataFrame, windows: Sequence[int] = K.VELOCITY_COUNTER_MINUTES,
                            watermark: str = "10 minutes") -> DataFrame:
    """G6 on a stream: counter after each event; a user's state is dropped once the
    watermark passes its last event + the largest window (the key would have expired)."""
    ev = events.withWatermark("timestamp", watermark).withColumn("_us", F.unix_micros("timestamp"))
    out_schema = T.StructType([T.StructField("transaction_id", T.StringType()),
                               T.StructField("user_id", T.StringType())]
                              + [T.StructField(f"counter_{m}m", T.LongType()) for m in windows])
    state_schema = T.StructType([T.StructField("last_us", T.LongType())]
                                + [T.StructField(f"c{m}", T.LongType()) for m in windows])
    return (ev.select("user_id", "transaction_id", "_us", "timestamp").groupBy("user_id")
              .applyInPandasWithState(_counter_fn(windows), out_schema, state_schema, "append",
                                      GroupStateTimeout.EventTimeTimeout))


def rolling_fraud_rate_stream(scored: DataFrame, watermark: str = "10 minutes", width: str = "1 hour",
                              slide: str = "5 minutes", threshold: float = K.FRAUD_LABEL_THRESHOLD) -> DataFrame:
    """K6: flagged / total per sliding event-time window, emitted once the watermark closes it."""
    return (scored.withWatermark("timestamp", watermark)
                  .groupBy(F.window("timestamp", width, slide).alias("w"))
                  .agg(F.count(F.lit(1)).alias("n_total"),
                       F.count_if(F.col("fraud_probability") >= threshold).alias("n_flagged"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          "n_total", "n_flagged", (F.col("n_flagged") / F.col("n_total")).alias("fraud_rate")))


def dedupe_stream(events: DataFrame, delay: str = "60 seconds", key: str = "transaction_id") -> DataFrame:
    """M9: a transaction id seen again within the watermark delay is dropped (prediction cache)."""
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark([key])


def list_dirs(spark, path: str) -> list[str]:
    """Child directory names of ``path`` on the cluster file system (empty if absent)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]


STORE_BUCKETS = 64
STORE_SCHEMA = ("user_id long, last_txn_amount double, last_txn_timestamp timestamp, last_txn_country string, "
                "updated_at timestamp")


def store_versions(spark, store_dir: str) -> dict[int, list[int]]:
    """bucket -> versions (ascending) present in the store."""
    out: dict[int, list[int]] = {}
    for v in list_dirs(spark, store_dir):
        for b in list_dirs(spark, f"{store_dir}/{v}"):
            if b.startswith("bucket="):
                out.setdefault(int(b[7:]), []).append(int(v[2:]))
    return {b: sorted(v) for b, v in out.items()}


def read_store(spark, store_dir: str, buckets: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
    """The newest version of each bucket (below version ``before``)."""
    paths = []
    for b, vs in store_versions(spark, store_dir).items():
        vs = [v for v in vs if before is None or v < before]
        if vs and (buckets is None or b in buckets):
            paths.append(f"{store_dir}/v={vs[-1]}/bucket={b}")
    return spark.read.schema(STORE_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], STORE_SCHEMA)


def drop_dir(spark, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def store_upsert_batch(store_dir: str, n_buckets: int = STORE_BUCKETS):
    """G4 on a stream: returns a foreachBatch function that merges each batch into the user table.

    The table is cut into hash buckets of the key; a batch rewrites the buckets it touches as version
    ``epoch`` (idempotent on replay) and drops their versions older than the one it replaces.
    """
    bucket = F.pmod(F.hash("user_id"), F.lit(n_buckets))

    def fn(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        updates = ST.user_updates(batch)
        touched = [r["b"] for r in updates.select(bucket.alias("b")).distinct().collect()]       # at most n_buckets
        store = read_store(spark, store_dir, touched, epoch)
        ST.upsert(store, updates).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket") \
            .parquet(f"{store_dir}/v={epoch}")
        for b, vs in store_versions(spark, store_dir).items():
            for v in [v for v in vs if v < epoch][:-1] if b in touched else []:
                drop_dir(spark, f"{store_dir}/v={v}/bucket={b}")
    return fn
