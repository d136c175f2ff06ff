import random

from pyspark.sql import functions as F

from veloscope.operators.asof import asof_join


def test_against_brute_force(spark):
    rnd = random.Random(4)
    key = lambda: rnd.choice([None, 1, 1, 1, 2, 3])
    hist = [(key(), rnd.choice([None, *range(0, 900, 7)]), i, rnd.choice([None, i * 1.5]), rnd.choice([None, None, f"c{i}"])) for i in range(500)]
    rows = [(i, key(), rnd.choice([None, *range(0, 1000, 5)])) for i in range(400)] + [(0, 1, 50), (0, 1, 50)]
    at = lambda c: F.timestamp_seconds(F.col(c))
    h = spark.createDataFrame(hist, "k long, s long, seq long, amount double, country string").withColumn("ts", at("s"))
    d = spark.createDataFrame(rows, "id long, k int, s long").withColumn("ts", at("s")).withColumn("_side", F.lit("clash"))
    for tolerance in (None, 60):
        got = asof_join(d, h, "k", "ts", "ts", ["amount", "country"], tolerance_seconds=tolerance, tiebreak=["seq"])
        assert got.columns == [*d.columns, "last_amount", "last_amount_at", "last_country", "last_country_at"]

        def want(k, s, field):
            past = [x for x in hist if k is not None and s is not None and x[0] == k and x[1] is not None and x[1] <= s and x[field] is not None]
            x = max(past, key=lambda x: (x[1], x[2]), default=None)
            return x[field] if x and (tolerance is None or s - x[1] <= tolerance) else None
        assert sorted((str((r["id"], r["k"], r["s"], r["last_amount"], r["last_country"])) for r in got.collect())) == \
            sorted(str((i, k, s, want(k, s, 3), want(k, s, 4))) for i, k, s in rows)
    assert asof_join(d.limit(0), h, "k", "ts", "ts", ["amount"]).count() == 0
    assert asof_join(d, h.limit(0), "k", "ts", "ts", ["amount"]).where("last_amount IS NULL").count() == len(rows)


def test_no_task_holds_a_key(spark):
    """The windows run inside (key, partition); only the table of partition ends is ordered by key alone."""
    d = spark.range(20_000).select(F.col("id"), F.lit(1).alias("k"), F.timestamp_seconds("id").alias("ts"), (F.col("id") * 2.0).alias("x"))
    got = asof_join(d.where("id % 2 = 1"), d.where("id % 2 = 0"), "k", "ts", "ts", ["x"])
    assert got.where("last_x = (id - 1) * 2.0").count() == 10_000
    rows = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 1 and max(r["count"] for r in rows) < 8_000
