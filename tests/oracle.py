"""Local stand-in for the driver's correctness gate.

Runs each registered query on Spark and its oracle SQL on DuckDB over the same
parquet tables, then compares column names, row counts and the multiset of
rows. ``python -m tests.oracle [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    return v


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, run, sql, sf_dir):
    t0 = time.time()
    df = run(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(_norm(x) for x in r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return {"name": name, "ok": None, "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = [tuple(_norm(x) for x in r) for r in cur.fetchall()]
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows), "spark_s": round(t1 - t0, 2)}
    if sorted(s_cols) != sorted(d_cols):
        res.update(ok=False, why=f"columns {sorted(s_cols)} vs {sorted(d_cols)}")
        return res
    order = [d_cols.index(c) for c in s_cols]
    d_rows = [tuple(r[i] for i in order) for r in d_rows]
    cs, cd = Counter(s_rows), Counter(d_rows)
    if cs == cd:
        res["ok"] = True
        return res
    only_s = list((cs - cd).elements())[:3]
    only_d = list((cd - cs).elements())[:3]
    diffcols = set()
    for a, b in zip(sorted(cs - cd, key=repr), sorted(cd - cs, key=repr)):
        diffcols |= {s_cols[i] for i in range(len(a)) if a[i] != b[i]}
    res.update(ok=False, why=f"cols differ {sorted(diffcols)[:8]}; spark {only_s[:2]} oracle {only_d[:2]}")
    return res


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    import os
    if os.environ.get("PLAIN_SESSION"):
        # a stock session, as an external driver would create it
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        from veloscope.session import get_session
        spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        try:
            r = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:300]}"}
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"FAILED {bad} of {len(names or qs)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
