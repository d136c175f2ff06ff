import re

from tests.conftest import SF_CHECK
from veloscope.llm import decontaminate as D

ITEM = ("Tom buys 12 apples and 7 pears at the market. Each apple weighs 150 g and each pear weighs 150 g. "
        "How much does the bag of Tom weigh when Anna takes 12 apples away?")
BENCH = [(1, ITEM), (2, "The quick brown fox jumps over the lazy dog near the river bank today"), (3, None), (4, "12 34 56"),
         (5, "three word item")]


def leaks(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, item_id int, share string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in D.find_leaks(docs, bench, **more).collect()}


def test_reparameterised_and_inconsistent(spark):
    changed = ITEM.replace("Tom", "Zoe").replace("12", "31").replace("7", "9").replace("150 g", "80 kg").replace("Anna", "Max")
    bad = changed.replace("pear weighs 80", "pear weighs 81").replace("takes 31", "takes 99")
    rows = [(1, "Intro words here. " + ITEM + " More text."), (2, "so " + changed), (3, bad), (4, ITEM.upper()),
            (5, "apples and pears are sold at the market every day, each apple is red"), (6, None), (7, ""), (None, ITEM),
            (1, ITEM), (8, " ".join(w for w in ITEM.split()[:30])), (9, "12 34 56 78 90"), (10, "a three, word item indeed"),
            (11, "word " * 50_000 + "the quick brown fox jumps over the lazy dog near the river bank today")]
    got = leaks(spark, rows)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (None, 1), (8, 1), (11, 2)}
    assert got[2, 1]["changed_slots"] >= 4 and got[2, 1]["found_share"] > 0.9     # a name that opens a sentence is a word
    assert got[3, 1]["found_share"] < 0.95
    assert got[1, 1]["changed_slots"] == 0
    assert leaks(spark, rows, block=8).keys() == got.keys()


def test_part_of_a_long_item(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(1, "it says " + " ".join(words[20:33]) + " and goes on"), (2, "it says " + " ".join(words[20:32]) + " and goes on"),
            (3, " x ".join(" ".join(words[i:i + 6]) for i in range(0, 30, 6)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in D.find_leaks(d, b).collect()] == [1]
    assert D.longest_run([(3, 13), (4, 14), (5, 15), (7, 17), (5, 2)]) == 3


def test_slots_decide(spark):
    """The same template with unrelated fillings at every place is not the item."""
    bench = [(1, "take 1 then 1 then 1 then 1 then 1 then 1 then 1 then 1")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame([(1, "take 5 then 5 then 5 then 5 then 5 then 5 then 5 then 5"),
                               (2, "take 1 then 2 then 3 then 4 then 5 then 6 then 7 then 8")], "doc_id long, text string")
    assert [r["doc_id"] for r in D.find_leaks(d, b).collect()] == [1]


def test_copy_between_variants(spark):
    """Slots are decided at each place: variants of the same template do not outvote a copy, nor each other."""
    item = "What is 12 times 7 plus 3 minus 4"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    first, second = "What is 5 times 9 plus 2 minus 6", "What is 5 times 8 plus 1 minus 6"
    rows = [(1, f"{first}. {item}. {second}."), (2, f"{first} {second}"), (3, f"{first} {item} {second}"), (4, item), (5, first),
            (6, f"{first}. What, pray, is 12 times 7 plus 3 minus 4? {second}"), (7, "what is 5 times more plus 1 minus nothing"),
            (8, " ".join([first, second] * 200 + [item]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["found_share"], r["changed_slots"]) for r in D.find_leaks(d, b).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 8}
    assert got[1] == got[3] == got[4] == got[8] == (1.0, 0) and got[2][0] == got[5][0] == 1.0 and got[2][1] == 4
    assert [r["doc_id"] for r in D.clean(d, b).collect()] == [7]


def test_items_without_windows(spark):
    """Short items, arithmetic and scripts without blanks."""
    bench = [(1, "Who wrote Hamlet?"), (2, "Name three primary colors."), (3, "12 + 30 - 4 = ?"), (4, "1, 2, 3, 5, 8, 13"),
             (5, "\u65e5\u672c\u306e\u9996\u90fd\u306f\u3069\u3053\u3067\u3059\u304b"), (6, "?!"), (7, "\u8c01\u5199\u4e86")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = [(1, "Quiz: who wrote Hamlet? Nobody knew."), (2, "Task 1\nname three primary colors\nRed."), (3, "Q: 12 + 30 - 4 = ? A: 38"),
            (4, "go on: 1 2 3 5 8 13"), (5, "\u95ee\u9898\u65e5\u672c\u306e\u9996\u90fd\u306f\u3069\u3053\u3067\u3059\u304b\u3002"),
            (6, "they who wrote Hamlet plays; name three. Primary colors! 12 + 30 - 4 + 1 = 39, 1, 2, 3, 5, 8 x 13?!"),
            (7, "a, \u8c01\u5199\u4e86\uff1f"), (8, "\u65e5\u672c\u3067\u8c01\u5199\u4e86\u672c"), (9, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (7, 7)}
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(d, b).collect()} == want | ({(6, 2)})
    assert {r["doc_id"] for r in D.clean(d, b).collect()} == {8, 9}


def test_clean_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM, "a", 1), (2, "fine text", "b", None)], "doc_id long, text string, lang string, item_id int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
    assert D.clean(docs, bench.limit(0)).count() == 2 and D.find_leaks(docs, bench.limit(0)).count() == 0
    assert D.clean(docs.limit(0), bench).count() == 0


def test_query_against_containment(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    want = {(d["doc_id"], b["item_id"]) for b in bench for d in docs if flat(b["text"]) in flat(d["text"])}
    got = {(r["doc_id"], r["item_id"]): r["found_share"] for r in D.op3_decontamination(spark, SF_CHECK).collect()}
    assert want and want <= set(got)
    assert all(got[x] < 1 for x in set(got) - want)
