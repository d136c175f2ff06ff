"""Registry decisions on absent versions and metrics, evaluation of null groups and unlabelled rows, the entry's guard."""
import sys

import pytest

from veloscope.operators import evaluation as EV
from veloscope.operators import registry as RG


def test_promoting_an_absent_version_changes_nothing(spark):
    reg = spark.createDataFrame([("m", 1, "Production"), ("m", 2, "Staging"), ("n", 7, "Production")], "name string, version long, stage string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(RG.promote(reg, "m", 9)) == rows(reg) and rows(RG.promote(reg, "n", 2)) == rows(reg)
    assert rows(RG.promote(reg, "m", 2)) == [("m", 1, "Archived"), ("m", 2, "Production"), ("n", 7, "Production")]


def test_gate_of_missing_metrics(spark):
    d = spark.createDataFrame([(0.9,), (0.7,), (0.69,), (float("nan"),), (None,)], "test_auc_pr double")
    assert [r["gate"] for r in RG.quality_gate(d).collect()] == ["register", "keep", "fail", "fail", "fail"]


def test_null_group_and_unlabelled_rows(spark):
    rows = [(i, g, (i * 7 % 10) / 10, int(i % 3 == 0)) for g in ("a", None) for i in range(40)]
    d = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "transaction_id long, g string, score double, is_fraud int")
    got = {r["g"]: r.asDict() for r in EV.evaluate(d, by=["g"]).collect()}
    assert set(got) == {"a", None}
    assert all(got["a"][k] == pytest.approx(got[None][k], rel=1e-9) for k in got["a"] if isinstance(got["a"][k], float))
    more = d.unionByName(spark.createDataFrame([(1000 + i, "a", 0.95, None) for i in range(9)], d.schema))
    key = lambda df: sorted((str(tuple(r)) for r in EV.threshold_table(df, by=["g"]).collect()))
    assert key(d) == key(more)


def test_entry_works_without_text_operators(monkeypatch):
    import __spark_entry__ as E
    whole = E.queries()
    plain = {n for n in whole if not n.startswith("op") or not n[2].isdigit()} - {"pipeline"}
    for missing in ("xxhash", "veloscope.llm", "corpus_pipeline"):
        for m in [m for m in sys.modules if m.startswith(("veloscope.llm", "corpus_pipeline"))]:
            monkeypatch.delitem(sys.modules, m)
        with monkeypatch.context() as c:
            c.setitem(sys.modules, missing, None)
            with pytest.warns(UserWarning, match="left out"):
                got = E.queries()
            assert plain <= set(got) and "pipeline" not in got
            assert ("op5_quality" in got) == (missing == "corpus_pipeline")
