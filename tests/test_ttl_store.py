"""The expiring store on hand-made slices: merges, expiry, a second life, restarts, and the work of a batch."""

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import ts
from veloscope.streaming import ttl_store as TS

SCHEMA = "transaction_id string, user_id string, amount double, merchant_category string, timestamp timestamp"


def run(spark, tmp_path, slices, ttl=3600):
    """Each slice is a run of its own, from the checkpoint of the one before; returns (expired rows, progress of each run)."""
    progress = []
    for i, rows in enumerate(slices):
        data = [(str(a) if a is not None else None, u, x, c, ts(t) if t else None) for a, u, x, c, t in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/slice_{i}")
        raw = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/slice_*")
        with TS.state_conf(spark):
            q = (TS.expiring_store(raw, ttl).writeStream.format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        progress.append(q.recentProgress)
    return [r.asDict() for r in spark.read.schema(TS.EXPIRED).parquet(f"{tmp_path}/out").collect()], progress


def live(spark, tmp_path):
    return {r["user_id"]: r.asDict() for r in TS.lookup(spark, f"{tmp_path}/checkpoint").collect()}


def us(t):
    import calendar
    return calendar.timegm(ts(t).timetuple()) * 1_000_000


def test_merges_expiry_and_second_life(spark, tmp_path):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    first = [(1, "7", 10.0, "travel", "2024-01-01 10:00:00"), (2, "7", None, "other", "2024-01-01 10:01:00"),
             (3, "8", 5.0, None, "2024-01-01 10:00:00"), (5, "8", 6.0, "other", "2024-01-01 10:00:00"), (4, "8", 7.0, "travel", "2024-01-01 10:00:00"),
             (9, None, 1.0, "other", "2024-01-01 10:00:00"), (10, "9", 1.0, "other", None)]
    expired, _ = run(spark, tmp_path / "a", [first])
    got = live(spark, tmp_path / "a")
    assert not expired and set(got) == {7, 8}               # rows without a user or a time are left out
    assert got[7]["amount"] == 10.0 and got[7]["merchant_category"] == "other" and got[7]["n_writes"] == 2      # a null keeps the older
    assert got[8]["amount"] == 6.0 and got[8]["n_writes"] == 3 and got[8]["n_categories"] == 2     # ties: the larger sequence
    assert got[7]["updated_us"] == us("2024-01-01 10:01:00")

    # user 7 writes again in time, an older write fills in nothing newer; user 8 expires and comes back
    second = [(6, "7", 20.0, None, "2024-01-01 10:40:00"), (7, "7", 1.0, "groceries", "2024-01-01 09:59:00")]
    third = [(11, "1", 2.0, "other", "2024-01-01 11:20:00")]
    fourth = [(12, "8", None, "travel", "2024-01-01 11:30:00")]
    expired, _ = run(spark, tmp_path / "b", [first, second, third, fourth])
    assert [(r["user_id"], r["amount"], r["n_writes"], r["n_categories"], r["updated_us"]) for r in expired] \
        == [(8, 6.0, 3, 2, us("2024-01-01 10:00:00"))]
    assert expired[0]["expired_ms"] * 1000 == us("2024-01-01 11:00:00")
    got = live(spark, tmp_path / "b")
    assert set(got) == {1, 7, 8}
    assert (got[7]["amount"], got[7]["merchant_category"], got[7]["updated_us"]) == (20.0, "other", us("2024-01-01 10:40:00"))
    assert (got[8]["amount"], got[8]["merchant_category"], got[8]["n_writes"], got[8]["n_categories"]) == (None, "travel", 1, 1)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_a_batch_touches_its_own_users_only(spark, tmp_path):
    many = [(i, str(i), 1.0, "other", "2024-01-01 10:00:00") for i in range(500)]
    few = [(1000 + i, str(i), 2.0, "other", "2024-01-01 10:01:00") for i in range(3)]
    _, progress = run(spark, tmp_path, [many, few])
    last = progress[-1][0]["stateOperators"][0]
    first = progress[0][0]["stateOperators"][0]
    assert last["numRowsUpdated"] * 50 < first["numRowsUpdated"]
    got = live(spark, tmp_path)
    assert len(got) == 500 and sum(r["n_writes"] for r in got.values()) == 503 and got[1]["amount"] == 2.0 and got[4]["amount"] == 1.0


def test_lookup_is_a_table(spark, tmp_path):
    run(spark, tmp_path, [[(1, "1", 1.0, "other", "2024-01-01 10:00:00")]])
    asked = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = asked.join(TS.lookup(spark, f"{tmp_path}/checkpoint"), "user_id", "left").orderBy("user_id").select("user_id", F.col("amount")).collect()
    assert [tuple(r) for r in got] == [(1, 1.0), (2, None)]


def test_round_trips_to_the_store_do_not_grow_with_reads():
    """A user's rows of a batch cost one read of the entry, one of the map, a write per category, one of the entry and the timers."""
    calls = []

    class State:
        def __init__(self, name):
            self.name, self.data = name, {}

        def __getattr__(self, what):
            def call(*a):
                calls.append(f"{self.name}.{what}")
                return {"get": lambda: self.data.get(""), "exists": lambda: "" in self.data, "update": lambda v: self.data.update({"": v}),
                        "containsKey": lambda k: k in self.data, "getValue": lambda k: self.data[k], "iterator": lambda: iter(self.data.items()),
                        "updateValue": lambda k, v: self.data.update({k: v}), "registerTimer": lambda t: None, "deleteTimer": lambda t: None}[what](*a)
            return call

    entry, by_category, store = State("entry"), State("map"), TS.UserEntries(1000)
    store.handle, store.entry, store.by_category = State("handle"), entry, by_category
    rows = pd.DataFrame({"us": [1, 2, 3, 4], "seq": [1, 2, 3, 4], "amount": [1.0, None, 3.0, None], "merchant_category": ["a", "b", None, "a"]})
    for _ in range(2):
        list(store.handleInputRows((1,), iter([rows]), None))
    assert by_category.data == {("a",): (4,), ("b",): (2,)}
    assert entry.data[""] == (4, 8, 3.0, 3, 3, "a", 4, 4)
    assert calls == ["entry.get", "map.updateValue", "map.updateValue", "handle.registerTimer", "entry.update",
                     "entry.get", "map.iterator", "map.updateValue", "map.updateValue", "entry.update"]
