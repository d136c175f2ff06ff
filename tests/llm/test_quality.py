import zlib

from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from veloscope.llm import quality as Q


def test_statistics_of_small_texts(spark):
    rows = [(1, None), (2, ""), (3, "Aa BB! 12\nAa BB! 12\n#"), (4, "x x x"), (None, "é" * 9), (3, "\n\n"), (6, "w " * 50_000)]
    df = spark.createDataFrame([(i, t, 0.5, "q") for i, t in rows], "doc_id long, text string, score double, quality string")
    got = Q.statistics(df).collect()
    assert len(got) == len(rows) and tuple(got[0].asDict())[1:] == Q.NAMES
    assert all(v is not None and v == v for r in got for k, v in r.asDict().items() if k != "doc_id")
    r = got[2]
    assert r["upper"] * 21 == 6 and abs(r["digit"] * 21 - 4) < 1e-9 and abs(r["shout"] * 21 - 2) < 1e-9
    assert abs(r["distinct_words"] - 4 / 7) < 1e-9 and abs(r["distinct_lines"] - 2 / 3) < 1e-9
    assert abs(got[3]["repeat_before"] - 2 / 3) < 1e-9
    assert Q.statistics(df.limit(0)).count() == 0


def test_paths_are_the_tree(spark):
    debug = """Tree
  If (feature 3 <= 0.5)
   If (feature 0 <= 2.0)
    Predict: 1.0
   Else (feature 0 > 2.0)
    Predict: 0.0
  Else (feature 3 > 0.5)
   Predict: 0.0
"""
    a, b = Q.NAMES[0], Q.NAMES[3]
    assert [r.bounds for r in Q.paths(debug)] == [((b, None, 0.5),), ((a, None, 2.0), (b, None, 0.5)),
                                                 ((a, 2.0, None), (b, None, 0.5)), ((b, 0.5, None),)]
    d = spark.createDataFrame([(1.0, 0.2), (3.0, 0.2), (1.0, 0.9)], f"{a} double, {b} double")
    m = Q.Model(0.0, ((Q.paths(debug)[1], 2.0), (Q.paths(debug)[3], -1.0)))
    got = [round(r[0], 6) for r in d.select(m.score()).collect()]
    assert got == [0.880797, 0.5, 0.268941]


def test_without_both_classes(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    stats = Q.statistics(df)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.classify(stats, none).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.99 for r in Q.classify(stats, ones).collect())


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in Q.op5_quality(spark, SF_CHECK).collect()}
    lab = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF_CHECK}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["score"], lab[i]) for i, r in got.items() if r["held_out"] and i in lab]
    good = sum((s >= 0.7) == (y == 1) for s, y in held) / len(held)
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert good > 0.93 and auc > 0.95, (good, auc, len(neg))


def test_labels_are_no_input(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").limit(200)
    lab = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = lab.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in Q.classify(Q.statistics(docs), x).collect()} for x in (lab, flipped))
    assert a == b
