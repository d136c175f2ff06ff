import hashlib
from collections import Counter, defaultdict

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.oracle import compare, duck
from veloscope.llm import mixing as M


def fill(budget, children):
    """{name: (cap, weight)} -> whole shares, by repeatedly closing full children."""
    open_, share = dict(children), {}
    while open_:
        left = budget - sum(share.values())
        total = sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if c * total <= w * left]
        if not full:
            return share | {n: min(c, w * left // total) for n, (c, w) in open_.items()}
        for n in full:
            share[n] = open_.pop(n)[0]
    return share


def brute_mix(docs, percent=M.BUDGET_PERCENT, epochs=M.MAX_EPOCHS):
    leaf, tokens = {}, defaultdict(int)
    for n, (i, t, lang, src) in enumerate(docs):
        src, lang = src or "", lang or ""
        dom = M.DOMAINS[int(src[3:]) % 3] if src[:3] == "src" and src[3:].isdigit() else "other"
        leaf[n] = (dom, lang, src)
        tokens[leaf[n]] += len(brute.words(t))
    level = {(): sum(tokens.values()) * percent // 100}
    for depth, name in enumerate(M.LEVELS):
        below = {}
        for parent, b in level.items():
            kids = defaultdict(int)
            for p, t in tokens.items():
                if p[:depth] == parent:
                    kids[p[depth]] += t * epochs
            got = fill(b, {k: (c, M.WEIGHTS[name].get(k, M.OTHER_WEIGHT)) for k, c in kids.items()})
            below |= {(*parent, k): v for k, v in got.items()}
        level = below
    out = Counter()
    for p, b in level.items():
        if not tokens[p]:
            continue
        full, rest = divmod(b, tokens[p])
        members = [(hashlib.md5(f"{M.SEED}|{full + 1}|{'' if docs[n][0] is None else docs[n][0]}".encode()).hexdigest(), n)
                   for n in leaf if leaf[n] == p]
        by_key = defaultdict(list)
        for k, n in members:
            by_key[k].append(n)
        run = 0
        for k in sorted(by_key):
            for n in by_key[k]:
                for e in range(1, full + 1 + (run < rest)):
                    out[docs[n][0], e] += 1
            run += sum(len(brute.words(docs[n][1])) for n in by_key[k])
    return out, level


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, lang string, source string, domain string, epoch int")
    table, cuts = M.plan(df, **more)
    got = Counter((r["doc_id"], r["epoch"]) for r in M.selected(table, cuts).collect())
    kept = M.mix(df, **more)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({i: 0 for i, _ in ()}) + sum(
        (Counter({i: c}) for (i, _), c in got.items()), Counter())
    return got


def test_small_tables(spark):
    rows = [(i, "w " * (i % 7), ["en", "de", None, "it"][i % 4], ["src0", "src1", "src5", None, "blog"][i % 5]) for i in range(80)]
    rows += [(3, "a b", "en", "src0"), (3, "a b", "en", "src0"), (None, "x y z", "en", "src0"), (90, None, "fr", "src9")]
    for percent, epochs in ((80, 3), (100, 1), (250, 3), (400, 3), (7, 2)):
        want, _ = brute_mix(rows, percent, epochs)
        assert run(spark, rows, percent=percent, max_epochs=epochs) == want, (percent, epochs)
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert M.mix(df).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    rows = [(i, "w " * 10, "en", "src0") for i in range(2)] + [(10 + i, "w " * 10, "en", "src3") for i in range(50)] \
        + [(100 + i, "w " * 10, "de", "src0") for i in range(50)] + [(200 + i, "w " * 10, "en", "src1") for i in range(50)]
    _, level = brute_mix(rows, 60, 1)
    web = {k: v for k, v in level.items() if k[0] == "web"}
    assert web["web", "en", "src0"] == 20                      # short
    total = sum(len(r[1].split()) for r in rows) * 60 // 100
    books = level["books", "en", "src1"]
    assert books == total * 3 // 8                             # the other domain gives and takes nothing
    assert sum(web.values()) >= total * 5 // 8 - 3
    assert run(spark, rows, percent=60, max_epochs=1) == brute_mix(rows, 60, 1)[0]


def test_query_matches_sql_and_brute_force(spark):
    r = compare(spark, duck(SF_SMALL), "op6_mixing", E.queries()["op6_mixing"], M.SQL, SF_SMALL)
    assert r["ok"], r
    docs = [tuple(x) for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    got = Counter((x["doc_id"], x["epoch"]) for x in M.op6_mixing(spark, SF_SMALL).collect())
    assert got == brute_mix(docs)[0] and max(e for _, e in got) > 1
