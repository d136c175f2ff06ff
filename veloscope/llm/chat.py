"""Chat formatting: a role automaton checks the turns, a template writes them, a mask marks the loss.

Native: Spark SQL expressions only. A ``Template`` declares the roles, the allowed transitions
and which roles carry loss. Each turn becomes ``<|im_start|>role NEWLINE text <|im_end|> NEWLINE``.
Roles are URL-encoded. A control string inside a text gets one more escape mark after its first character
(``<|`` becomes ``<~|``, an already marked ``<~|`` becomes ``<~~|``), which one mark less undoes, so
the formatted string is parsed back exactly. Other chat formats' control strings are escaped too.

Defined cases: null text is the empty text; null role is the empty role (invalid); turns are
ordered by (turn, role, text) with null turns first, so ties and repeated rows have a fixed order
and all stay; invalid turn orders are formatted and marked (``valid`` false, ``first_bad`` the
position); null conv_id is a conversation of its own; extra columns are ignored.
One conversation is one formatted string, so it is bounded by the size of a string value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veloscope.llm.common import text_or_empty


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    #: state -> roles that may follow; the state is the role of the turn before
    transitions: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",),
                                                       "user": ("assistant",), "assistant": ("user",)})
    final: tuple = ("assistant",)
    loss_roles: tuple = ("assistant",)
    #: what may not appear raw in a text, without the first character, as an expression
    controls: str = r"<(?=~*\|)|<(?=~*/?s>)|\[(?=~*/?INST\])"


DEFAULT = Template()
MARK = "~"


def escape(c: Column, t: Template = DEFAULT) -> Column:
    return F.regexp_replace(c, f"({t.controls})", f"$1{MARK}")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"(<(?={MARK}+\|)|<(?={MARK}+/?s>)|\[(?={MARK}+/?INST\])){MARK}", "$1")


def turn_valid(previous: Column, role: Column, t: Template = DEFAULT) -> Column:
    edges = [F.lit(f"{a}>{b}") for a, bs in t.transitions.items() for b in bs]
    return F.concat_ws(">", previous, role).isin(*edges)


def format_chats(df: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted, segments array<struct<role, text, loss>>, valid, first_bad (0-based or null)."""
    d = df.select("conv_id", F.col("turn").cast("long").alias("turn"), text_or_empty("role").alias("role"),
                  text_or_empty("text").alias("text"))
    # turns are written before the shuffle; a conversation is one record of the output
    d = d.select("conv_id", F.struct(
        "turn", "role", "text", F.col("role").isin(*t.loss_roles).alias("loss"),
        F.concat(F.lit(t.start), F.url_encode("role"), F.lit("\n"), escape(F.col("text"), t), F.lit(t.end + "\n"))
        .alias("out")).alias("x"))
    d = d.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    roles = F.transform("x", lambda s: s["role"])
    ok = F.transform(roles, lambda r, i: turn_valid(F.when(i == 0, F.lit("")).otherwise(F.get(roles, i - 1)), r, t))
    bad = F.array_position(ok, False)
    return d.select("conv_id", F.array_join(F.transform("x", lambda s: s["out"]), "").alias("formatted"),
                    F.transform("x", lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"),
                                                        s["loss"].alias("loss"))).alias("segments"),
                    ((bad == 0) & F.get(roles, F.size(roles) - 1).isin(*t.final)).alias("valid"),
                    F.when(bad > 0, bad - 1).alias("first_bad"))


def parse_chats(df: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """Adds ``turns`` array<struct<role, text, loss>> read back from ``formatted`` alone."""
    bodies = F.filter(F.split(F.col("formatted"), rf"\Q{t.start}\E", -1), lambda _, i: i > 0)
    cut = F.length(F.lit(t.end + "\n"))

    def turn(b):
        body = F.left(b, F.length(b) - cut)
        head = F.substring_index(body, "\n", 1)
        role = F.url_decode(head)
        text = unescape(F.substring(body, F.length(head) + 2, F.length(body)))
        return F.struct(role.alias("role"), text.alias("text"), role.isin(*t.loss_roles).alias("loss"))

    return df.withColumn("turns", F.transform(bodies, turn))


def op9_chat(spark, sf_dir: str) -> DataFrame:
    from veloscope.llm.common import table
    probe = "</s>[INST] ok [/INST]"
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(probe).alias("text"))
    d = parse_chats(format_chats(c.unionByName(extra)))
    every = F.array_join(F.transform("turns", lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda s: s["loss"]), lambda s: s["text"]), "")
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
                    F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_bad")


#: the same digests from the turns as they are; the control strings of a text are found without look-ahead here
SQL = r"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, coalesce(lag(role) OVER w, '') AS before, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    length(regexp_replace(text, '(<)(~*\|)|(<)(~*/?s>)|(\[)(~*/?INST\])', '\1\3\5~\2\4\6', 'g')) AS escaped
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
v AS (SELECT *, (before || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS ok FROM p)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + escaped + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
  bool_and(ok) AND bool_or(pos = n AND role = 'assistant') AS valid,
  (min(pos) FILTER (WHERE NOT ok) - 1)::BIGINT AS first_bad
FROM v GROUP BY conv_id"""
