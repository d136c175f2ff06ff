"""The online store as keyed state that expires (G1, G4, G5): ``transformWithState`` on the RocksDB store.

A user's entry is a value state (fields, each with the time and sequence of its write; time of the newest write; number of
writes) and a map state (writes by category). A null in a write leaves the field as it was, an older write fills only
fields that no newer one has set. One event-time timer per user stands at the newest write plus the time to live; when the
watermark passes it, the entry is emitted as expired and both states go. Entries are read back from the checkpoint by the state
reader, so lookups need no second copy of the store.

A micro-batch reads and writes the entries of its own users only, and its commit uploads the changes of these (changelog
checkpoints): the cost does not depend on the size of the store. A user's rows of one micro-batch are merged by one task,
an Arrow batch at a time.

Defined cases: rows without a user or a time are left out; rows behind the watermark are dropped by Spark; ties of time go
to the larger sequence; a category that is null counts as a write but is in no map entry.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from veloscope import constants as K

FIELDS = ("amount", "merchant_category")
ENTRY = ("updated_us long, n_writes long, amount double, amount_us long, amount_seq long, "
         "merchant_category string, merchant_category_us long, merchant_category_seq long")
EXPIRED = "user_id long, amount double, merchant_category string, n_writes long, n_categories long, updated_us long, expired_ms long"
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_NEVER = -(1 << 62)


class UserEntries(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY)
        self.by_category = handle.getMapState("by_category", "category string", "n long")

    def _deadline(self, updated_us: int) -> int:
        return updated_us // 1000 + self.ttl_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.entry.get()              # every call is a round trip to the store; none without an entry
        newest, n = (old[0], old[1]) if old else (_NEVER, 0)
        fields = {f: tuple(old[2 + 3 * i:5 + 3 * i]) if old else (None, None, None) for i, f in enumerate(FIELDS)}
        seen: dict[str, int] = {}
        for pdf in rows:
            us, seq = pdf["us"].to_numpy(), pdf["seq"].to_numpy()
            order = np.lexsort((seq, us))
            for f in FIELDS:
                known = order[pdf[f].notna().to_numpy()[order]]
                if len(known):
                    j = known[-1]
                    at = (int(us[j]), int(seq[j]))
                    if fields[f][1] is None or at >= fields[f][1:]:
                        v = pdf[f].iloc[j]
                        fields[f] = (v.item() if hasattr(v, "item") else v, *at)
            for c, m in Counter(pdf["merchant_category"].dropna().tolist()).items():
                seen[c] = seen.get(c, 0) + m
            newest, n = max(newest, int(us.max())), n + len(us)
        before = {k[0]: v[0] for k, v in self.by_category.iterator()} if old and seen else {}
        for c, m in seen.items():
            self.by_category.updateValue((c,), (before.get(c, 0) + m,))
        if old is None or newest != old[0]:
            if old is not None:
                self.handle.deleteTimer(self._deadline(old[0]))
            self.handle.registerTimer(self._deadline(newest))
        self.entry.update((newest, n, *[x for f in FIELDS for x in fields[f]]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        e, at = self.entry.get(), expiredTimerInfo.getExpiryTimeInMs()
        if e is None:
            return
        if self._deadline(e[0]) > at:
            return                          # written again since this timer was set
        n_categories = sum(1 for _ in self.by_category.keys())
        self.entry.clear()
        self.by_category.clear()
        yield pd.DataFrame({"user_id": [key[0]], "amount": pd.array([e[2]], "Float64"), "merchant_category": pd.array([e[5]], "string"),
                            "n_writes": [e[1]], "n_categories": [n_categories], "updated_us": [e[0]], "expired_ms": [at]})

    def close(self) -> None:
        pass


def expiring_store(events: DataFrame, ttl_seconds: int = K.STORE_TTL_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """The stream of entries that expire; live ones stay in the state (``lookup``)."""
    e = events.where(F.col("user_id").isNotNull() & F.col("timestamp").isNotNull()).withWatermark("timestamp", watermark)
    e = e.select(F.col("user_id").cast("long").alias("user_id"), "timestamp", F.unix_micros("timestamp").alias("us"),
                 F.coalesce(F.col("transaction_id").cast("long"), F.lit(-1)).alias("seq"), *FIELDS)
    return e.groupBy("user_id").transformWithStateInPandas(UserEntries(ttl_seconds * 1000), EXPIRED, "append", "EventTime")


@contextmanager
def state_conf(spark: SparkSession):
    """The settings that a query with an expiring store is started under."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def lookup(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The live entries as of the last committed micro-batch, a row per user."""
    def state(name):
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    n = state("by_category").groupBy(F.col("key.user_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n_categories"))
    entries = state("entry").select("key.user_id", "value.amount", "value.merchant_category", "value.n_writes", "value.updated_us")
    return entries.join(n, "user_id", "left").fillna(0, ["n_categories"])
