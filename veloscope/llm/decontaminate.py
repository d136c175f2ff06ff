"""Benchmark decontamination by templates, with a check that the slots are filled consistently.

Canonical tokens: words in lower case, numbers as <num>, unit words right after a number as <unit>,
capitalised words inside a sentence as <name> (a text all in capitals has none). A template window is
``window`` successive tokens; windows without a literal word are no evidence and are not used.
Windows are compared twice: with names as placeholders (finds re-parameterised questions) and with
names as words (finds copies whose case was changed).

The benchmark is the stated query set: its windows go to all tasks as sorted hash arrays, in blocks of
at most ``BLOCK`` windows (12 MB), one pass over the documents per block, so its size is bounded at
any benchmark size. At each place of a document where an item's windows line up, a matching window proposes
what fills each slot of the item; windows whose fillings contradict the majority filling of a slot at that place do not
count (a question with two equal numbers must have equal numbers in the copy), so variants of the same template
elsewhere in the document do not outvote a copy; the best place is reported. An item leaks if at least ``share`` of its
distinct windows are found consistently, or ``RUN`` successive ones (13 tokens) stand in a row in the document, so that
a long part of a long item is caught too.

An item without windows (fewer tokens than a window, or no literal word) is found as a whole: its words and numbers as
written but for case, between two borders (the text's ends, line ends, marks other than those that join words or numbers), found
share 1 and one window; inside a running clause so few tokens are too little to tell a leak from chance. Letters of
scripts without blanks between words are tokens of their own.

Defined cases: null texts are empty (no windows); items without a token, or null, are never found; repeated items are found each; repeated documents are reported each; a null doc_id is reported as null; extra columns are
ignored (or kept, by ``clean``); an empty documents or benchmark table gives no leaks.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloscope.llm.common import documents, table, text_or_empty

TOKEN = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|[.!?\n]")
#: letters of scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Han): each is a token
ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff" \
        "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
HAS_ALONE = re.compile(f"[{ALONE}]")
TOKEN_ALONE = re.compile(rf"[0-9]+(?:[.,][0-9]+)*|[{ALONE}]|[^\W\d_{ALONE}]+|[.!?\n]")
#: what between two tokens is a border of a short item: a new line, or a mark that does not join words or numbers
BORDER = re.compile(r"\n|[^\s+\-*/\u00d7\u00f7^'\u2019_]")
#: fixed values: unit words that become <unit> after a number
UNITS = ("mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "inch", "inches",
         "foot", "feet", "mg", "g", "kg", "t", "oz", "lb", "lbs", "gram", "grams", "kilogram", "kilograms", "pound", "pounds",
         "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute",
         "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "mph", "kmh",
         "percent", "dollar", "dollars", "usd", "eur", "euro", "euros", "cent", "cents", "degree", "degrees", "watt", "watts",
         "volt", "volts", "byte", "bytes", "kb", "mb", "gb")
WINDOW, SHARE = 5, 0.5
RUN = 9                 # successive windows that are a leak whatever the item's length
BLOCK = 1 << 20         # benchmark windows that one pass compares
MEMO = 1 << 18
END, NUM, UNIT, NAME = (np.uint64(x) for x in (0, 2, 4, 6))
_R = np.uint64(0x9E3779B97F4A7C15)


class TokenIds(dict):
    """Token -> even id of its lower-cased form; odd if it is written Capitalised. Bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        if token in ".!?\n":
            x = int(END)
        elif token[0] in "0123456789":
            x = int(NUM)
        else:
            x = (xxhash.xxh64_intdigest(token.lower().encode("utf-8", "surrogatepass")) & ~1 | 1 << 40) \
                | (len(token) > 1 and token[0].isupper() and token[1:].islower())
        self[token] = x
        return x


UNIT_IDS = np.array(sorted(TokenIds()[u] for u in UNITS), np.uint64)


@dataclass
class Template:
    words: list                 # the tokens as written, without sentence ends
    plain: np.ndarray           # ids with <num> and <unit>
    named: np.ndarray           # the same with <name>


def token_pattern(text: str) -> re.Pattern:
    return TOKEN if text.isascii() or not HAS_ALONE.search(text) else TOKEN_ALONE


def canonical(text: str | None, memo: TokenIds) -> Template:
    found = token_pattern(text or "").findall(text or "")
    ids = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    end = ids == END
    starts = np.concatenate(([True], end[:-1]))[~end]       # first word of a sentence or line
    words = found if not end.any() else [w for w, e in zip(found, end.tolist()) if not e]
    ids = ids[~end]
    capital = (ids & np.uint64(1)).astype(bool)
    ids = ids & ~np.uint64(1)
    after_number = np.concatenate(([False], ids[:-1] == NUM))
    if after_number.any():
        at = np.flatnonzero(after_number)
        ids[at[np.isin(ids[at], UNIT_IDS)]] = UNIT
    named = ids.copy()
    named[capital & ~starts & (ids > NAME)] = NAME
    return Template(words, ids, named)


def windows(ids: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the windows that hold a literal word."""
    n = len(ids) - w + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, literal = np.full(n, w, np.uint64), np.zeros(n, bool)
    for i in range(w):
        part = ids[i:i + n]
        h = (h ^ part) * _R
        h ^= h >> np.uint64(31)
        literal |= part > NAME
    return h[literal], np.flatnonzero(literal)


@dataclass
class Items:
    """A block of benchmark templates, by item."""
    templates: dict = field(default_factory=dict)
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    where: dict = field(default_factory=lambda: defaultdict(list))      # hash -> [(row, start, named)]
    totals: dict = field(default_factory=dict)                            # row -> windows per form
    whole: dict = field(default_factory=lambda: defaultdict(list))      # tokens of an item without windows -> [row]


def build(items: list[tuple], w: int) -> Items:
    out, memo = Items(), TokenIds()
    for row, (item, text) in enumerate(items):
        t = canonical(text, memo)
        out.templates[row] = (item, t)
        for form, ids in enumerate((t.plain, t.named)):
            h, at = windows(ids, w)
            out.totals[row, form] = len(h)
            for x, p in zip(h.tolist(), at.tolist()):
                out.where[x].append((row, p, form))
        if t.words and not out.totals[row, 0] and not out.totals[row, 1]:
            out.whole[tuple(x.lower() for x in t.words)].append(row)
    out.hashes = np.array(sorted(out.where), np.uint64)
    return out


def contains(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return sorted_hashes[at] == h


def whole_matches(text: str, items: Items) -> set[int]:
    """Rows of the items without windows whose tokens stand in the text, as written but for case, between two borders."""
    words, border, end = [], [True], 0                  # border[i]: one is before token i
    for m in token_pattern(text).finditer(text):
        if m[0] in ".!?\n":
            continue
        if words:
            border.append(BORDER.search(text, end, m.start()) is not None)
        words.append(m[0].lower())
        end = m.end()
    border = border[:len(words)] + [True]
    lengths = sorted({len(x) for x in items.whole})
    return {row for i in range(len(words)) if border[i] for n in lengths if i + n <= len(words) and border[i + n]
            for row in items.whole.get(tuple(words[i:i + n]), ())}


def longest_run(pairs: list[tuple]) -> int:
    """Most successive windows (item start, document start) that are found one after another."""
    have, best = set(pairs), 0
    for p, d in pairs:
        if (p - 1, d - 1) not in have:
            n = 1
            while (p + n, d + n) in have:
                n += 1
            best = max(best, n)
    return best


def decide(fills: list[tuple], chosen: dict) -> None:
    """Adds the majority filling of each slot that ``chosen`` does not have yet."""
    votes = defaultdict(Counter)
    for _, _, fill in fills:
        for a, x in fill:
            if a not in chosen:
                votes[a][x] += 1
    chosen.update((a, min(c, key=lambda x: (-c[x], x != a, x))) for a, c in votes.items())


def best_alignment(fills: list[tuple], length: int, total: int, share: float) -> tuple | None:
    """(share found, windows found, -changed slots, slots filled) of the best place of an item in a document, or None.

    ``fills``: (item start, document start, fillings) per hit. A place is a diagonal (document start minus item start): its
    own hits fill the slots first, then nearer diagonals before farther ones, up to the item's ``length`` away (words put in
    or left out). The whole document is a place too, for an item whose parts stand far apart.
    """
    best = None                 # (windows found, -changed slots, slots)

    def judge(some, chosen):
        nonlocal best
        kept = [(p, d) for p, d, fill in some if all(chosen[a] == x for a, x in fill)]
        good = len({p for p, _ in kept})
        if good / total >= share or longest_run(kept) >= RUN:
            score = (good, -sum(a != x for a, x in chosen.items()), len(chosen))
            best = score if best is None else max(best, score)
        return len(kept)

    chosen: dict = {}
    decide(fills, chosen)
    if judge(fills, chosen) < len(fills):               # something contradicts: place by place
        at = defaultdict(list)
        for p, d, fill in fills:
            if len(dict(fill)) == len(fill):            # a window that contradicts itself counts nowhere
                at[d - p].append((p, d, fill))
        order = sorted(at)
        starts = {x: {p for p, _, _ in at[x]} for x in order}
        lo = hi = 0
        near: Counter = Counter()                       # item start -> diagonals of the band that hold it
        for x in order:
            while hi < len(order) and order[hi] <= x + length:
                near.update(starts[order[hi]])
                hi += 1
            while order[lo] < x - length:
                for p in starts[order[lo]]:
                    near[p] -= 1
                    if not near[p]:
                        del near[p]
                lo += 1
            if len(near) < min(share * total, RUN) or (best is not None and (len(near), 0) <= best[:2]):
                continue                                # cannot be a leak, or not a better one
            band, chosen = sorted(order[lo:hi], key=lambda y: (abs(y - x), y)), {}
            for y in band:
                decide(at[y], chosen)
            judge([f for y in band for f in at[y]], chosen)
    return None if best is None else (best[0] / total, *best)


def matches(text: str | None, items: Items, w: int, share: float, memo: TokenIds) -> list[tuple]:
    """[(item_id, share found, windows found, slots filled, changed slots)] of the items a text leaks."""
    t = canonical(text, memo)
    hits = defaultdict(list)                # (row, form) -> [(item start, document start)]
    for form, ids in enumerate((t.plain, t.named)):
        if form and np.array_equal(t.plain, t.named) and not hits:
            break                           # no names and nothing found: the second form is the first
        h, at = windows(ids, w)
        for i in np.flatnonzero(contains(items.hashes, h)).tolist():
            for row, p, f in items.where[int(h[i])]:
                if f == form:
                    hits[row, form].append((p, int(at[i])))
    best: dict = {}
    for (row, form), pairs in hits.items():
        total = items.totals[row, form]
        if len({p for p, _ in pairs}) < min(share * total, RUN):
            continue
        b = items.templates[row][1]
        slots = (b.named if form else b.plain) <= NAME
        fills = [(p, d, {(b.words[p + i].lower(), t.words[d + i].lower()) for i in range(w) if slots[p + i]}) for p, d in pairs]
        score = best_alignment(fills, len(b.words), total, share)
        if score is not None:
            best[row] = max(best.get(row, (0.0,)), score)
    if items.whole:
        best |= {row: (1.0, 1, 0, 0) for row in whole_matches(text or "", items)}
    return sorted(((items.templates[r][0], s[0], s[1], s[3], -s[2]) for r, s in best.items()), key=lambda x: (x[0] is None, x[0] or 0))


def benchmark_blocks(bench: DataFrame, w: int, block: int = BLOCK):
    """The benchmark as blocks of at most ``block`` windows, streamed through the driver one at a time."""
    part, size = [], 0
    for r in bench.select(F.col("item_id").cast("long").alias("i"), text_or_empty().alias("t")).orderBy("i", "t").toLocalIterator():
        n = len(token_pattern(r["t"]).findall(r["t"])) * 2
        if part and size + n > block:
            yield build(part, w)
            part, size = [], 0
        part.append((r["i"], r["t"]))
        size += n
    if part:
        yield build(part, w)


LEAK = ("doc_id long, item_id long, found_share double, windows_found long, slots long, changed_slots long")


def find_leaks(docs: DataFrame, bench: DataFrame, window: int = WINDOW, share: float = SHARE, id_col: str = "doc_id",
               text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per (document, benchmark item) that leaks."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("found_share", pa.float64()),
                        ("windows_found", pa.int64()), ("slots", pa.int64()), ("changed_slots", pa.int64())])
    out = None
    for items in benchmark_blocks(bench, window, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            memo = TokenIds()
            for b in batches:
                rows = [(i, *m) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                        for m in matches(t, shared.value, window, share, memo)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        found = d.mapInArrow(run, LEAK)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], LEAK)


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, share: float = SHARE, text_col: str = "text",
          block: int = BLOCK) -> DataFrame:
    """``docs`` (all columns) without the documents that leak an item; one map pass per benchmark block."""
    for items in benchmark_blocks(bench, window, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            memo = TokenIds()
            for b in batches:
                keep = [not matches(t, shared.value, window, share, memo) for t in b.column(text_col).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
