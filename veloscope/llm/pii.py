"""PII spans: expressions propose, checksums confirm, nearby words adjust the score.

Native: every step is a Spark SQL expression. A regular expression per kind gives the matches
of a text (``regexp_extract_all``) and the gaps between them (``split`` by the same
expression); the running sum of gap and match lengths gives each match its code-point span.

The expressions are the contract's with three changes that keep the matches and bound the time
on very long texts: possessive loops where nothing after the loop could take characters back,
and, where a match may start anywhere in a run of one class, a start only at the head of the
run or at the end of the previous match (a later start in the run meets the same continuation).

Base kinds (always kept when their checks pass): email, ip (parts <= 255), card (13-19 digits,
Luhn), phone (9-15 digits). Added kinds need a score of at least ``threshold``: iban (mod-97),
ssn and tel (national phone form), whose score depends on words near the span; an added span that
touches a base span, or an added one kept before it, is left out.

Defined cases: a null text is the empty text (no spans); repeated rows give one result row each;
a null id stays null; columns other than id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veloscope.llm.common import text_or_empty

LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    regex: str
    needs: str          # a cheap necessary condition: the class of characters a match contains
    prior: float
    base: bool
    near: str           # words that raise the score when they stand near
    far: str = "version|build|release|order|ref|chapter|section"


KINDS = (
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, True,
         "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", "[0-9]", 0.7, True,
         "ip|host|server|address|addr"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 0.6, True, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+", 0.7, True, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         "[0-9]", 0.3, False, "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]", 0.3, False, "ssn|social|security"),
    Kind("tel", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", "[0-9]",
         0.3, False, "phone|tel|call|mobile|fax|telefon|teléfono"),
)
THRESHOLD = 0.5
CONTEXT = 40        # characters on either side that are searched for context words


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a short digit string."""
    r = F.reverse(digits)

    def add(s, i):
        d = F.ascii(F.substring(r, i, F.lit(1))) - 48
        return s + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 7064 mod 97-10 of an IBAN written with or without blanks."""
    s = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def add(r, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _part_ok(p: Column) -> Column:
    """A digit string of any length is at most 255."""
    p = F.regexp_replace(p, "^0+", "")
    return (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255"))


def confirmed(kind: Column, m: Column) -> Column:
    """Does the checksum or range of the kind hold for the matched string?"""
    n = F.length(_digits(m))
    ok = F.when(kind == "email", F.lit(True))
    ok = ok.when(kind == "ip", F.forall(F.split(m, "\\."), _part_ok))
    ok = ok.when(kind == "card", F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False))
    ok = ok.when(kind == "phone", n.between(9, 15))
    ok = ok.when(kind == "iban", mod97(m))
    ok = ok.when(kind == "ssn", ~m.rlike("^(000|666|9)|-00-|-0000$"))
    return ok.otherwise(True)


def _matches(text: Column, order: int, kind: Kind) -> Column:
    """array<struct<kind, i, gap, before, after, m>>, one per match; empty if the text can have none."""
    m = F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0))
    gaps = F.transform(F.split(text, kind.regex, -1), lambda g: F.struct(
        F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("tail"), F.left(g, F.lit(CONTEXT)).alias("head")))
    both = F.struct(m.alias("m"), gaps.alias("g"))
    rows = F.transform(F.array(both), lambda b: F.transform(b["m"], lambda x, i: F.struct(
        F.lit(order).alias("kind"), i.alias("i"), F.get(b["g"], i)["n"].alias("gap"),
        F.get(b["g"], i)["tail"].alias("before"), F.get(b["g"], i + 1)["head"].alias("after"), x.alias("m"))))[0]
    return F.when(text.rlike(kind.needs), rows)


def proposals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per proposed span (and one with null ``kind`` for a text without any)."""
    d = df.select(F.monotonically_increasing_id().alias("_r"), F.col(id_col).alias("_id"),
                  text_or_empty(text_col).alias("_t"))
    found = F.flatten(F.array_compact(F.array(*[_matches(F.col("_t"), i, k) for i, k in enumerate(KINDS)])))
    d = d.select("_r", "_id", F.explode_outer(found).alias("x")).select("_r", "_id", "x.*")
    # one exchange by row serves the windows and the final aggregate
    d = d.repartition("_r")
    upto = Window.partitionBy("_r", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(upto).cast("long")
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return d.withColumn("end", end).withColumn("start", F.col("end") - F.length("m")) \
            .withColumn("name", F.get(names, F.col("kind")))


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Spans that stay: (_r, _id, kind, name, start, end, m, base, score); rows without a span keep null kind."""
    d = proposals(df, id_col, text_col)
    near = F.lower(F.concat_ws(" ", "before", "after"))
    score = F.lit(None).cast("double")
    for i, k in enumerate(KINDS):
        s = F.lit(k.prior) + F.when(near.rlike(rf"\b(?:{k.near})"), 0.3).otherwise(0.0) \
            - F.when(near.rlike(rf"\b(?:{k.far})\b"), 0.2).otherwise(0.0) \
            + F.when(F.lit(k.name == "iban"), 0.4).otherwise(0.0)
        score = F.when(F.col("kind") == i, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))).otherwise(score)
    d = d.withColumn("ok", F.coalesce(confirmed(F.col("name"), F.col("m")), F.lit(False)))
    d = d.withColumn("score", score).withColumn("base", F.coalesce(F.col("kind") < sum(k.base for k in KINDS), F.lit(False)))
    d = d.withColumn("keep", F.col("ok") & (F.col("base") | (F.col("score") >= threshold)))
    # an added span yields to any kept base span it touches, and to an added one before it
    by_start = Window.partitionBy("_r").orderBy("start", "kind")
    base_end = F.when(F.col("base") & F.col("keep"), F.col("end"))
    base_start = F.when(F.col("base") & F.col("keep"), F.col("start"))
    d = d.withColumn("_be", F.max(base_end).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = d.withColumn("_bs", F.min(base_start).over(by_start.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    d = d.withColumn("_ae", F.max(F.when(~F.col("base") & F.col("keep"), F.col("end")))
                     .over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    touches = (F.coalesce(F.col("_be") > F.col("start"), F.lit(False))
               | F.coalesce(F.col("_bs") < F.col("end"), F.lit(False))
               | F.coalesce(F.col("_ae") > F.col("start"), F.lit(False)))
    keep = F.col("keep") & (F.col("base") | ~touches)
    return d.select("_r", "_id", F.when(keep, F.col("kind")).alias("kind"), "name", "start", "end", "m", "base",
                    F.when(keep, F.col("score")).alias("score"))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, counts per base kind, ``base`` and ``spans`` arrays (kind, start, end, score)."""
    d = scored(df, id_col, text_col, threshold)
    span = F.struct("kind", "start", "end", "score", "name")
    kept = F.col("kind").isNotNull()
    counts = [F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base]
    # spans of one document only: bounded by its length
    return d.groupBy("_r").agg(F.first("_id").alias(id_col), *counts,
                               F.array_sort(F.collect_list(F.when(kept & F.col("base"), span))).alias("base"),
                               F.array_sort(F.collect_list(F.when(kept, span))).alias("spans")).drop("_r")


def _written_spans(c: str) -> Column:
    return F.array_join(F.transform(F.col(c), lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    from veloscope.llm.common import documents
    d = find_pii(documents(spark, sf_dir))
    return d.select("doc_id", *[F.col(f"n_{k.name}") for k in KINDS if k.base],
                    F.sha2(_written_spans("base"), 256).alias("base_sha256"), _written_spans("spans").alias("spans"),
                    (F.size("spans") - F.size("base")).alias("n_added"),
                    F.array_min(F.transform("spans", lambda s: s["score"])).alias("lowest_score"))
