from collections import Counter

import corpus_pipeline as P
from tests.conftest import SF_CHECK
from tests.llm.test_materialise import check as check_records
from tests.llm.test_mixing import brute_mix
from tests.llm.test_simhash import kept_of
from veloscope.llm import decontaminate, materialise
from veloscope.llm.common import documents, written


def rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def test_stages_against_plain_versions(spark):
    docs = documents(spark, SF_CHECK)
    cols = docs.columns
    before = rows(docs)

    # quality: what is marked good stays, most of what is marked bad goes
    kept = written(P.quality_stage(spark, docs, SF_CHECK), "t")
    assert kept.columns == cols
    after = rows(kept)
    lab = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    ids = {r[0] for r in after}
    good = [i for i, q in lab.items() if q == 1]
    bad = [i for i, q in lab.items() if q == 0]
    assert sum(i in ids for i in good) >= 0.97 * len(good) and sum(i in ids for i in bad) <= 0.15 * len(bad)
    assert set(after) <= set(before) and len(after) < len(before)

    # near duplicates: one document of each component of the SimHash operator
    kept = written(P.near_dedup_stage(spark, kept, SF_CHECK), "t")
    assert kept.columns == cols
    before, after = after, rows(kept)
    assert sorted(((r[0], r[1] or "") for r in after), key=str) == kept_of([r[:2] for r in before])
    assert len(after) < len(before)

    # decontamination
    kept = written(P.decontamination_stage(spark, kept, SF_CHECK), "t")
    assert kept.columns == cols
    before, after = after, rows(kept)
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(documents(spark, SF_CHECK), spark.read.parquet(f"{SF_CHECK}/benchmark.parquet")).collect()}
    assert {r[0] for r in after} == {r[0] for r in before} - leaks

    # mixing
    mixed = written(P.mixing_stage(spark, kept, SF_CHECK), "t")
    assert mixed.columns == cols
    want, _ = brute_mix(after, P.MIX_PERCENT, P.MIX_EPOCHS)
    by_id = Counter()
    for (i, _), n in want.items():
        by_id[i] += n
    assert Counter(r[0] for r in rows(mixed)) == by_id

    # training order
    recs = P.training_order_stage(spark, mixed, SF_CHECK).collect()
    check_records([(r[0], r[1]) for r in rows(mixed)], recs, materialise.LENGTH, materialise.PER_SHARD)


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF_CHECK}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    assert [len(x) for x in P.STAGES] == [2] * 5 and P.ORACLE_SQL is None
