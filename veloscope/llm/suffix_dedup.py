"""Repeated byte strings: depth-limited radix sort of sampled suffixes over all documents.

A byte is removed if a string of ``DEPTH`` bytes covering it also starts elsewhere (same document included). To
find all such strings without ordering a suffix per byte, suffixes are sampled by content: each window of DEPTH
bytes elects its leftmost smallest ``DIGIT``-byte string by hash, so equal windows elect equal strings at
equal offsets, and successive windows that elect the same position form a run. The elected suffixes
are then split by most significant digit, as far as DEPTH bytes and no further:

1. by the elected DIGIT bytes: a string elected once cannot lie in a repeated window (most drop out here);
2. by all bytes of the run's windows: equal groups of two or more places are repeated as a whole;
3. groups that still hold different continuations: by ranges of window offsets, a quarter of the range before at each pass, until
   single windows. A digit is what all windows of the range have in common: places that are alone with theirs drop
   out; places equal in all windows of the range are repeated there, and one of them goes on to stand for them.

Equal groups after the last pass are exactly the repeated windows. Exact copies of a text are seen by a 128-bit
digest of the text and need one representative. Every pass has a row per place and range that is still open, and counts
with map-side aggregation; groups are counted and joined back by salted keys, so one passage in a third of all documents is
spread as well. Texts travel once by digest, and once more only where pass 3 must decide. Long texts are searched in
overlapping blocks.

Defined cases: a null text is the empty text; texts of fewer than DEPTH bytes have nothing removed (also exact
copies of them); null ids stay null; repeated rows each get a result row and count as places of their own;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloscope.llm.common import text_or_empty, written

DEPTH, DIGIT = 400, 128
BLOCK_BITS = 20         # a block of texts searched at once: 1 MiB
SALTS = 64              # tasks that count and join one group
_MAX = np.uint64(2**64 - 1)
_POS = np.uint64((1 << BLOCK_BITS) - 1)


class Roller:
    """Hashes of all DIGIT-byte strings of a block: prefix sums of byte codes times powers, modulo 2^64."""

    def __init__(self, size: int):
        code = np.random.default_rng(400).integers(0, 2**64, 256, dtype=np.uint64)
        base = 0x9E3779B97F4A7C15
        self.code, self.up = code, self._powers(base, size)
        self.down = self._powers(pow(base, -1, 2**64), size)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out, m = np.ones(n, np.uint64), 1
        while m < n:
            k = min(m, n - m)
            out[m:m + k] = out[:k] * np.uint64(pow(base, m, 2**64))
            m += k
        return out

    def hashes(self, b: np.ndarray, width: int) -> np.ndarray:
        c = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.code[b] * self.up[:len(b)], out=c[1:])
        h = (c[width:] - c[:-width]) * self.down[:len(c) - width]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    x = np.full(-(-n // w) * w, _MAX)
    x[:n] = v
    x = x.reshape(-1, w)
    left = np.minimum.accumulate(x, 1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def blocks(texts: list[bytes], depth: int, limit: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """(bytes, [(row, offset in its text, length)]) of at most ``limit`` bytes; long texts overlap by depth - 1."""
    parts, segs, size = [], [], 0
    for row, t in enumerate(texts):
        for at in range(0, max(len(t) - depth + 1, 0), limit - depth + 1):
            piece = t[at:at + limit] if len(t) > limit else t
            if size + len(piece) > limit:
                yield b"".join(parts), segs
                parts, segs, size = [], [], 0
            parts.append(piece)
            segs.append((row, at, len(piece)))
            size += len(piece)
    if segs:
        yield b"".join(parts), segs


def runs(texts: list[bytes], depth: int, digit: int, roller: Roller, limit: int = 1 << BLOCK_BITS):
    """Per block: (row, p, before, after, elected hash, block, first byte, last window) arrays of the runs.

    ``p`` is the elected position in the text; the run's windows start at p - before .. p - after.
    """
    for buf, segs in blocks(texts, depth, limit):
        b = np.frombuffer(buf, np.uint8)
        row, at, size = (np.array(x, np.int64) for x in zip(*segs))
        end = np.cumsum(size)
        start = end - size
        h = roller.hashes(b, digit)
        elected = sliding_min((h & ~_POS) | np.arange(len(h), dtype=np.uint64), depth - digit + 1)
        elected = (elected & _POS).astype(np.int64)
        seg_of = np.repeat(np.arange(len(segs)), size)[:len(elected)]
        s = np.flatnonzero(np.arange(len(elected)) + depth <= end[seg_of])      # windows inside one text
        p, seg = elected[s], seg_of[s]
        first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (seg[1:] != seg[:-1]))))
        a, z = s[first], s[np.append(first[1:], len(s)) - 1]
        p, seg = p[first], seg[first]
        yield row[seg], p - start[seg] + at[seg], p - a, p - z, h[p], buf, a, z


ANCHORS = pa.schema([("kh", pa.int64()), ("ctx", pa.int64()), ("tk", pa.binary()), ("p", pa.int64()), ("before", pa.int32()),
                     ("after", pa.int32())])
ANCHORS_SQL = "kh long, ctx long, tk binary, p long, before int, after int"


def elected(docs: DataFrame, depth: int, digit: int) -> DataFrame:
    """One row per run of the texts in (tk, text)."""

    def run(batches):
        roller = None
        for b in batches:
            roller = roller or Roller((1 << BLOCK_BITS) + 1)
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            keys = np.array(b.column("tk").to_pylist(), object)
            for row, p, before, after, kh, buf, a, z in runs(texts, depth, digit, roller):
                ctx = [xxhash.xxh64_intdigest(buf[x:y]) for x, y in zip(a.tolist(), (z + depth).tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(kh.view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64)),
                    pa.array(keys[row].tolist(), pa.binary()), pa.array(p), pa.array(before.astype(np.int32)),
                    pa.array(after.astype(np.int32))], schema=ANCHORS)

    return docs.mapInArrow(run, ANCHORS_SQL)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes (touching ones are one run)."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def outcome(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    spans = united(spans)
    kept, at = hashlib.sha256(), 0
    for a, z in spans:
        kept.update(text[at:a])
        at = z
    kept.update(text[at:])
    return len(text), sum(z - a for a, z in spans), len(spans), kept.hexdigest()


STEP = pa.schema([("kind", pa.int32()), ("tk", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                  ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kh", pa.int64()), ("p", pa.int64()),
                  ("before", pa.int32()), ("after", pa.int32()), ("asks", pa.bool_()),
                  ("data", pa.binary()), ("spans", pa.list_(pa.int64()))])
STEP_SQL = ("kind int, tk binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kh long, p long, before int, "
            "after int, asks boolean, data binary, spans array<long>")
DONE, CONTEXT, PENDING = 0, 1, 2
OUT_ROWS = 2000


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def first_step(depth: int):
    """Texts with their runs: finished where passes 1 and 2 decide; else contexts for pass 3 and the text itself."""

    def run(batches):
        for b in batches:
            rows = []
            for tk, text, copies, found in zip(*(b.column(c).to_pylist() for c in ("tk", "text", "copies", "runs"))):
                t = text.encode("utf-8", "surrogatepass")
                whole = copies > 1 and len(t) >= depth
                spans = [(0, len(t))] if whole else []
                asked = False
                for r in found or ():
                    a, z = r["p"] - r["before"], r["p"] - r["after"] + depth
                    if r["covered"]:
                        spans.append((a, z))
                    asks = r["asks"] and not whole
                    asked |= asks
                    if asks or r["serves"]:
                        rows.append((CONTEXT, tk, None, None, None, None, r["kh"], r["p"], r["before"], r["after"], asks, t[a:z], None))
                if asked:
                    rows.append((PENDING, tk) + (None,) * 9 + (t, [x for s in united(spans) for x in s]))
                else:
                    rows.append((DONE, tk, *outcome(t, spans)) + (None,) * 7)
                if len(rows) >= OUT_ROWS:
                    yield batch(rows, STEP)
                    rows = []
            if rows:
                yield batch(rows, STEP)

    return run


PLACE = ["kh", "tk", "p", "before", "after", "asks", "lo", "hi"]
PLACE_SQL = "kh long, tk binary, p long, before int, after int, asks boolean, lo int, hi int, core binary, whole binary"


def digits(depth: int):
    """Each place and range of offsets lo .. hi with ``core``, what all its windows share, and ``whole``, all bytes of its windows."""

    def run(batches):
        for b in batches:
            core, whole = [], []
            for data, before, after, lo, hi in zip(*(b.column(c).to_pylist() for c in ("data", "before", "after", "lo", "hi"))):
                core.append(hashlib.blake2b(data[before - lo:before + depth - hi], digest_size=16).digest())
                a, z = max(lo, after), min(hi, before)          # the windows of the range that the place has
                whole.append(hashlib.blake2b(b"%d %d " % (a, z) + data[before - z:before - a + depth], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in PLACE), pa.array(core, pa.binary()), pa.array(whole, pa.binary())],
                                             [*PLACE, "core", "whole"])

    return run


def quarters(df: DataFrame) -> DataFrame:
    """``df`` with the quarters of its ranges that hold windows of the place."""
    width = F.ceil((F.col("hi") - F.col("lo") + 1) / 4).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(
        (F.col("lo") + i * width).cast("int").alias("lo"), F.least(F.col("hi"), F.col("lo") + (i + 1) * width - 1).cast("int").alias("hi")))
    mine = F.filter(parts, lambda q: (q["lo"] <= q["hi"]) & (q["lo"] <= F.col("before")) & (q["hi"] >= F.col("after")))
    return df.withColumn("q", F.explode(mine)).withColumns({"lo": F.col("q.lo"), "hi": F.col("q.hi")}).drop("q")


def with_group(df: DataFrame, key: list[str], **aggs) -> DataFrame:
    """``df`` with aggregates of its groups, name = (first, merge, column): counted and joined back by (key, salt)."""
    part = df.groupBy(*key, "salt").agg(*[first(c).alias(n) for n, (first, _, c) in aggs.items()])
    total = part.groupBy(*key).agg(*[merge(n).alias(n) for n, (_, merge, _) in aggs.items()])
    return df.join(part.select(*key, "salt").join(total, key), [*key, "salt"])


def repeated_windows(places: DataFrame, depth: int, digit: int) -> DataFrame:
    """Pass 3: the spans (tk, a, z) of the ``places`` that ask and share windows with another place of their group."""
    place, split = F.struct("tk", "p"), []
    group, name = ["kh", "lo", "hi", "core"], ["tk", "p", "before", "after"]
    data = places.select(*name, "data")
    # pass 2 has compared all windows at once; the bytes stay in ``places``, passes move digests only
    go = quarters(places.withColumns({"lo": F.lit(0), "hi": F.lit(depth - digit)}))
    while True:
        live = go.mapInArrow(digits(depth), PLACE_SQL).withColumn("salt", F.pmod(F.xxhash64("tk", "p"), F.lit(SALTS)))
        live = written(live, "digits")
        if split and live.isEmpty():
            break
        same = with_group(live, [*group, "whole"], low=(lambda _: F.min(place), F.min, None), high=(lambda _: F.max(place), F.max, None))
        same = written(same.withColumn("covered", F.col("low") != F.col("high")), "split")
        split.append(same.where("covered AND asks").select(
            "tk", (F.col("p") - F.least("hi", "before")).alias("a"), (F.col("p") - F.greatest("lo", "after") + depth).alias("z")))
        one = same.where(place == F.col("low")).withColumn("asks", F.col("asks") & ~F.col("covered")).drop("low", "high", "covered")
        one = with_group(one, group, n=(lambda _: F.count(F.lit(1)), F.sum, None), wanted=(F.max, F.max, "asks"))
        one = one.where("n > 1 AND wanted AND hi > lo")
        go = quarters(one.select(*PLACE)).join(data, name)
    out = split[0]
    for more in split[1:]:
        out = out.unionByName(more)
    return out


def last_step(batches):
    schema = pa.schema([STEP.field(c) for c in ("tk", "n_bytes", "n_removed", "n_spans", "kept_sha256")])
    for b in batches:
        rows = []
        for tk, t, spans, more in zip(*(b.column(c).to_pylist() for c in ("tk", "data", "spans", "more"))):
            pairs = list(zip(spans[::2], spans[1::2])) + [(m["a"], m["z"]) for m in more or ()]
            rows.append((tk, *outcome(t, pairs)))
        if rows:
            yield batch(rows, schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), a row per input row."""
    text = text_or_empty(text_col)
    docs = df.select(F.col(id_col).alias("_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("tk"))
    # pass 1: strings elected in two places at least
    a = elected(docs.select("tk", "text"), depth, digit)
    twice = a.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kh")
    found = written(a.join(twice, "kh"), "candidates")
    # pass 2: equal contexts; two different places make a class repeated
    place = F.struct("tk", "p")
    cls = found.groupBy("kh", "ctx").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    cls = written(cls.select("kh", "ctx", "low", (F.col("low") != F.col("high")).alias("covered")), "classes")
    many = cls.groupBy("kh").agg(F.count(F.lit(1)).alias("continuations"))
    member = found.dropDuplicates(["tk", "p", "before", "after"]).join(cls, ["kh", "ctx"]).join(many, "kh")
    member = member.select(
        "tk", "p", "before", "after", "kh", "covered",
        (~F.col("covered") & (F.col("continuations") > 1)).alias("asks"),
        ((place == F.col("low")) & (F.col("continuations") > 1)).alias("serves")).where("covered or asks or serves")
    # the runs of one text: bounded by its length
    per_text = member.groupBy("tk").agg(F.collect_list(F.struct(*[c for c in member.columns if c != "tk"])).alias("runs"))
    texts = docs.groupBy("tk").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    step = written(texts.join(per_text, "tk", "left").mapInArrow(first_step(depth), STEP_SQL), "first-step")
    places = written(step.where(F.col("kind") == CONTEXT).select("kh", "tk", "p", "before", "after", "asks", "data"), "places")
    more = repeated_windows(places, depth, digit).groupBy("tk").agg(F.collect_list(F.struct("a", "z")).alias("more"))
    pending = step.where(F.col("kind") == PENDING).select("tk", "data", "spans").join(more, "tk", "left")
    names = ["tk", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    done = pending.mapInArrow(last_step, "tk binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string") \
        .unionByName(step.where(F.col("kind") == DONE).select(*names))
    return docs.select("_id", "tk").join(done, "tk").select(F.col("_id").alias(id_col), *names[1:])


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from veloscope.llm.common import documents
    return remove_repeats(documents(spark, sf_dir))


#: every window of every text, as hexadecimal digits: the plain statement, for tables of a few MB
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n_bytes FROM d),
w AS (SELECT r, unnest(range(0, n_bytes - {DEPTH} + 1)) AS s, h FROM n WHERE n_bytes >= {DEPTH}),
k AS (SELECT r, s, md5(substr(h, 2 * s + 1, 2 * {DEPTH})) AS k FROM w),
m AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS c FROM k) WHERE c > 1),
g AS (SELECT r, s, CASE WHEN s > lag(s) OVER (PARTITION BY r ORDER BY s) + {DEPTH} OR lag(s) OVER (PARTITION BY r ORDER BY s) IS NULL
    THEN 1 ELSE 0 END AS new FROM m),
i AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS span FROM g),
spans AS (SELECT r, span, min(s) AS a, max(s) + {DEPTH} AS z FROM i GROUP BY r, span),
gaps AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS z0, a FROM spans
    UNION ALL SELECT r, max(z), NULL FROM spans GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * z0 + 1, 2 * (coalesce(a, n_bytes) - z0)), '' ORDER BY z0) AS h
    FROM gaps JOIN n USING (r) GROUP BY r),
removed AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
FROM n LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)"""
