"""Mixing sources to target weights by hierarchical budgets over a domain / language / source tree.

A node's capacity is its tokens times ``max_epochs``. The token budget goes from the root down: at each
node it is shared among the children in proportion to their integer weights, no child above its
capacity, what a full child cannot take going to its siblings (water filling). As a node's own
capacity is the sum of its leaves', a shortage is made good by siblings first and reaches the ancestors'
other children only when a whole subtree is short. Shares are whole tokens, rounded down.

A leaf's budget is some complete epochs and a prefix of one more, in that epoch's seeded order (md5 of
seed, epoch and id): all documents whose preceding tokens in that order are below the rest; documents of
equal keys (equal ids) enter together. The prefix is found as a cut key per leaf: token totals per key
bin (65 536 bins of a uniform hash), running totals over bins, then the rows of the one bin the
cut falls into. No leaf is ever sorted as a whole, and the documents themselves are not shuffled: the cuts (a
row per leaf) are joined to them.

Defined cases: a null lang or source is '' (domain 'other'); a null text has no tokens; documents without
tokens follow the order like others; leaves with zero capacity or weight get no budget and no rows; a null id
is the empty id in the order; repeated rows are separate rows of equal key; clashing extra columns are
kept (``mix``) or ignored (``plan``); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloscope.llm.common import WORD, text_or_empty, written

LEVELS = ("domain", "lang", "source")
#: target weights of the children of a node by name; others get OTHER_WEIGHT
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2, "other": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
OTHER_WEIGHT = 1
DOMAINS = ("web", "books", "code")      # by the source's number modulo 3
BUDGET_PERCENT, MAX_EPOCHS, SEED = 80, 3, 17
BIN_DIGITS = 4


def domain_of(source: Column) -> Column:
    n = F.regexp_extract(source, "^src([0-9]{1,9})$", 1)
    return F.when(n == "", "other").otherwise(F.get(F.array(*[F.lit(d) for d in DOMAINS]), F.when(n != "", n).cast("int") % 3))


def order_key(epoch: Column, id_col: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def n_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def leaf_columns(df: DataFrame) -> dict[str, Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return {"domain": domain_of(source), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "source": source}


def weight_of(level: str, weights: dict) -> Column:
    c = F.lit(OTHER_WEIGHT)
    for name, w in weights.get(level, {}).items():
        c = F.when(F.col(level) == name, w).otherwise(c)
    return c.cast("long")


def waterfill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``share`` to children with (cap, weight) and their parent's ``budget``; whole numbers throughout."""
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight"))
    by = whole.orderBy(ratio.asc_nulls_last(), name)
    t = nodes.withColumn("_before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("_from", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("_full", (F.col("weight") > 0) & (F.col("cap") * F.col("_from") <= F.col("weight") * (F.col("budget") - F.col("_before"))))
    t = t.withColumn("_taken", F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0)))
    t = t.withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole))
    rest = F.floor(F.expr("(weight * (budget - _taken)) div nullif(_open, 0)"))
    return t.withColumn("share", F.when(F.col("_full"), F.col("cap")).when(
        F.col("weight") > 0, F.least("cap", F.greatest(F.lit(0), F.coalesce(rest, F.lit(0))))).otherwise(0).cast("long")) \
        .drop("_before", "_from", "_full", "_taken", "_open")


def budgets(leaves: DataFrame, weights: dict = WEIGHTS, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``leaves``: LEVELS and tokens, a row per leaf of the tree. Adds ``budget`` (tokens)."""
    t = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    t = t.withColumn("budget", F.expr(f"(sum(tokens) over ()) * {percent} div 100"))
    for depth, level in enumerate(LEVELS):
        path, parent = list(LEVELS[:depth + 1]), list(LEVELS[:depth])
        nodes = t.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first("budget").alias("budget"))
        share = waterfill(nodes.withColumn("weight", weight_of(level, weights)), parent, level).select(*path, "share")
        t = t.join(F.broadcast(share), path).withColumn("budget", F.col("share")).drop("share")    # a row per tree node
    return t.drop("cap")


def plan(docs: DataFrame, weights: dict = WEIGHTS, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
         id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): rows has a line per document with its leaf and tokens; cuts a line per leaf with its budget,
    ``full`` epochs and the ``cut`` key of the epoch after them (null: none)."""
    rows = written(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in leaf_columns(docs).items()],
                               n_tokens(text_or_empty(text_col)).alias("n_tokens")), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    cuts = written(budgets(leaves, weights, percent, max_epochs)
                   .withColumn("full", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0))
                   .withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")), "mix-leaves")
    # the tree has a row per leaf: as large as the weight table, not as the data
    keyed = rows.join(F.broadcast(cuts.where("rest > 0").select(*LEVELS, "full", "rest")), list(LEVELS)) \
        .withColumn("key", order_key(F.col("full") + 1, F.col("doc_id"), seed)) \
        .withColumn("bin", F.substring("key", 1, BIN_DIGITS))
    bins = keyed.groupBy(*LEVELS, "bin").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("bin")
    bins = bins.withColumn("before", F.sum("t").over(upto) - F.col("t")) \
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest")))
    one = keyed.join(F.broadcast(bins.select(*LEVELS, "bin", "before")), [*LEVELS, "bin"])      # a bin per leaf
    run = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key"))     # equal keys together
    cut = one.withColumn("run", run).where("run >= rest").groupBy(*LEVELS).agg(F.min("key").alias("cut"))
    return rows, written(cuts.join(cut, list(LEVELS), "left"), "mix-cuts")


def selected(rows: DataFrame, cuts: DataFrame, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (with LEVELS) once per epoch that takes them; adds ``epoch`` and ``budget``."""
    d = rows.join(F.broadcast(cuts.select(*LEVELS, "budget", "full", "cut")), list(LEVELS))
    more = (F.col("cut").isNotNull() & (order_key(F.col("full") + 1, F.col(id_col), seed) <= F.col("cut"))).cast("int")
    upto = (F.col("full") + F.coalesce(more, F.lit(0))).cast("int")
    return d.withColumn("epoch", F.explode(F.when(upto > 0, F.sequence(F.lit(1), upto)))).drop("full", "cut")


def mix(docs: DataFrame, weights: dict = WEIGHTS, percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the mixture with all their columns, a row per epoch that takes them."""
    _, cuts = plan(docs, weights, percent, max_epochs, seed, id_col, text_col)
    d = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_id"), *[c.alias(k) for k, c in leaf_columns(docs).items()])
    return selected(d, cuts, seed, "_id").select("_doc.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    from veloscope.llm.common import documents
    rows, cuts = plan(documents(spark, sf_dir))
    return selected(rows, cuts).select("doc_id", *LEVELS, "n_tokens", "budget", F.col("epoch").cast("long").alias("epoch"))


def _fill_sql(level: str, depth: int) -> str:
    path, parent = ", ".join(LEVELS[:depth + 1]), ", ".join(LEVELS[:depth]) or "1"
    above = "SELECT sum(tokens) * %d // 100 AS budget FROM leaf" % BUDGET_PERCENT if depth == 0 else f"SELECT * FROM b{depth - 1}"
    names = " ".join(f"WHEN {level} = '{k}' THEN {w}" for k, w in WEIGHTS[level].items())
    weight = f"CASE {names} ELSE {OTHER_WEIGHT} END" if names else str(OTHER_WEIGHT)
    on = "ON true" if depth == 0 else f"USING ({', '.join(LEVELS[:depth])})"
    return f"""n{depth} AS (SELECT {path}, sum(tokens) * {MAX_EPOCHS} AS cap, {weight} AS weight FROM leaf GROUP BY {path}),
a{depth} AS (SELECT n.*, p.budget,
    coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wfrom
  FROM n{depth} n JOIN ({above}) p {on} WINDOW w AS (PARTITION BY {parent} ORDER BY cap / weight, {level})),
f{depth} AS (SELECT *, cap * wfrom <= weight * (budget - before) AS sat FROM a{depth}),
b{depth} AS (SELECT {path}, CASE WHEN sat THEN cap ELSE least(cap,
    (weight * (budget - coalesce(sum(CASE WHEN sat THEN cap END) OVER (PARTITION BY {parent}), 0)))
    // sum(CASE WHEN NOT sat THEN weight END) OVER (PARTITION BY {parent})) END AS budget FROM f{depth})"""


SQL = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
    CASE WHEN regexp_matches(source, '^src[0-9]{{1,9}}$') THEN ['{"', '".join(DOMAINS)}'][CAST(substr(source, 4) AS INT) % 3 + 1]
         ELSE 'other' END AS domain FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{", ".join(_fill_sql(level, depth) for depth, level in enumerate(LEVELS))},
l AS (SELECT leaf.*, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS complete
    FROM leaf JOIN b2 USING (domain, lang, source)),
o AS (SELECT d.*, budget, complete, budget - complete * tokens AS rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('{SEED}|' || (complete + 1) || '|' || coalesce(doc_id::VARCHAR, ''))
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - n_tokens AS before
  FROM d JOIN l USING (domain, lang, source)),
e AS (SELECT *, complete + CASE WHEN before < rest THEN 1 ELSE 0 END AS epochs FROM o)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, budget::BIGINT AS budget,
    unnest(range(1, epochs::BIGINT + 1))::BIGINT AS epoch FROM e"""
