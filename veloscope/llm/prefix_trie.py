"""Conversation prefix trie: double-array tries per prefix shard, shared nodes merged globally.

Turns become pairs of 64-bit hashes of (role, text). A conversation is cut into units of at most ``BAND`` turns, each with
the key of the prefix before it (the depth-mixed hashes of the prefix, xored), so a conversation of any length is spread over many rows.
Units are range-partitioned by their prefix and first turns and cut into shards of about ``SHARD`` turns: neighbouring
conversations share a shard, and a first turn or a whole conversation that very many rows repeat fills several shards. A
shard numbers its turns densely and packs its trie into the arrays BASE and CHECK (state s goes by turn id c to
t = BASE[s] + c if CHECK[t] = s); traversing it with its units gives every node's part of an aggregate. A node that several shards
hold has the same (depth, prefix key) in each, and its parts are merged by one grouping.

Subtree sums need no walk up the tree: each node belongs to its smallest member, and below a node that a conversation owns it
owns the rest of its path. So the tokens saved in a node's subtree are what its members own in all, less what its smallest
member owns above the node; leaves alike. The passes over the shards are: members and smallest member per node; what each unit
owns; the members' sums per node. The conversations that end at a node are hashed in streams, in order, from pieces of id ranges.

Defined cases: rows with a null conv_id belong to no conversation; a null role or text is empty; null turns come first, ties
go by role, then by length and hashes of the text; repeated rows are turns of their own; an empty table gives no rows; other
columns are ignored. Two prefixes of one depth count as one if 128 bits agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veloscope.llm.common import table, written
from veloscope.operators.prefix import running_sums

BAND, SHARD = 4096, 1 << 16         # turns of a unit; turns of a shard's trie
PIECE = 4 << 20                     # characters of joined ids that a task holds
NODE = ["depth", "k1", "k2"]
_G = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The hash of a turn at this depth."""
    x = h.view(np.uint64) ^ (depth.astype(np.uint64) * _G)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


class DoubleArray:
    """A trie as BASE and CHECK; state 0 is its root, -1 in CHECK a free slot."""

    def __init__(self):
        self.base, self.check, self.size = np.zeros(64, np.int64), np.full(64, -1, np.int64), 1
        self.check[0] = 0

    def grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, np.int64)))
        self.size = max(self.size, size)

    def free(self, least: int) -> np.ndarray:
        slots = np.flatnonzero(self.check[1:self.size] < 0) + 1
        if len(slots) < least:
            new = np.arange(self.size, self.size + least - len(slots))
            self.grow(self.size + len(new))
            slots = np.concatenate((slots, new))
        return slots

    def fit(self, codes: np.ndarray, tries: int = 16) -> int:
        """A BASE at which all (ascending) codes meet free slots: first fit, else behind the end."""
        for slot in self.free(0)[:tries]:
            at = slot - codes[0] + codes
            if at[-1] < self.size and (self.check[at] < 0).all():
                return int(slot - codes[0])
        base = self.size - int(codes[0])
        self.grow(base + int(codes[-1]) + 1)
        return base

    def place(self, parent: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Slots of new children (parent, code), sorted by both."""
        out = np.empty(len(parent), np.int64)
        first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        count = np.diff(np.append(first, len(parent)))
        for a, n in zip(first[count > 1].tolist(), count[count > 1].tolist()):
            base = self.fit(code[a:a + n])
            out[a:a + n] = base + code[a:a + n]
            self.check[out[a:a + n]], self.base[parent[a]] = parent[a], base
        one = first[count == 1]                     # a single child takes any free slot
        slot = self.free(len(one))[:len(one)]
        out[one], self.check[slot], self.base[parent[one]] = slot, parent[one], slot - code[one]
        return out

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The state after ``code``, -1 where there is none."""
        at = self.base[state] + code
        inside = (at > 0) & (at < self.size)
        return np.where(inside & (self.check[np.where(inside, at, 0)] == state), at, -1)


class Shard:
    """The units of a shard in (conv, blk) order and their trie; the first step goes to the prefix a unit starts from."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("conv", "ascending"), ("blk", "ascending")]).combine_chunks()
        for c in ("conv", "blk", "start", "p1", "p2"):
            setattr(self, c, t.column(c).to_numpy())
        lists = {c: pa.concat_arrays(t.column(c).chunks) for c in ("h1", "h2", "len")}
        h1, h2, self.len = (x.flatten().to_numpy() for x in lists.values())
        offset = lists["h1"].offsets.to_numpy()
        self.offset, self.count = offset[:-1] - offset[0], np.diff(offset)
        self.h1, self.h2 = h1, h2
        self.turn, n_turns = dense(h1, h2)
        self.root, n_roots = dense(self.start, self.p1, self.p2)
        self.root += n_turns
        self.width = n_turns + n_roots
        self.trie = DoubleArray()
        self.build()

    def alive(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Units that take this step, and their codes."""
        if not step:
            return np.arange(len(self.conv)), self.root
        units = np.flatnonzero(self.count >= step)
        return units, self.turn[self.offset[units] + step - 1]

    def build(self) -> None:
        trie, state, made = self.trie, np.zeros(len(self.conv), np.int64), []
        k1, k2 = self.p1.copy(), self.p2.copy()
        for step in range(int(self.count.max(initial=0)) + 1):
            units, code = self.alive(step)
            pair, first, back = np.unique(state[units] * self.width + code, return_index=True, return_inverse=True)
            parent = pair // self.width
            slot = trie.place(parent, pair % self.width)
            state[units] = slot[back]
            some = units[first]                     # one unit for each new node
            if step:
                at, depth = self.offset[some] + step - 1, self.start[some] + step
                every, deep = self.offset[units] + step - 1, self.start[units] + step
                k1[units] ^= mixed(self.h1[every], deep)
                k2[units] ^= mixed(self.h2[every], deep)
                made.append((slot, parent, depth, k1[some], k2[some], self.len[at], np.zeros(len(slot), bool)))
            else:
                made.append((slot, slot, self.start[some], k1[some], k2[some], np.zeros(len(slot), np.int64), np.ones(len(slot), bool)))
        self.slot, self.parent, self.depth, self.k1, self.k2, self.last, self.top = (np.concatenate(x) for x in zip(*made))
        self.at = np.full(trie.size, -1, np.int64)          # the node's place in these arrays, by slot
        self.at[self.slot] = np.arange(len(self.slot))
        self.up = self.at[self.parent]

    def walk(self):
        """(step, units, their nodes) by BASE and CHECK."""
        state = np.zeros(len(self.conv), np.int64)
        for step in range(int(self.count.max(initial=0)) + 1):
            units, code = self.alive(step)
            state[units] = self.trie.step(state[units], code)
            if (state[units] < 0).any():
                raise AssertionError("a turn is not in the trie")
            yield step, units, self.at[state[units]]


def dense(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers 0.. of the distinct rows, and how many there are."""
    if not len(columns[0]):
        return np.empty(0, np.int64), 0
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum()) + 1


def arrow(names: str, columns) -> pa.Table:
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names.split(), columns)})


def longs(names: str) -> str:
    return ", ".join(f"{c} long" for c in names.split())


# --- rebuilding conversations ------------------------------------------------------------------------------------------


def numbered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, i, h1, h2, len): the turns of each conversation numbered from 0; no task holds a whole conversation."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    d = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), r.alias("role"),
                                                 t.alias("text"))
    d = d.select("conv", F.struct(F.col("turn").isNotNull().alias("dated"), "turn", "role", F.length("text").cast("long").alias("len"),
                                  F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role").alias("h2")).alias("o"))
    d = running_sums(d.withColumn("one", F.lit(1).cast("long")), ["conv"], "o", ["one"])
    return d.select("conv", (F.col("run_one") - 1).alias("i"), "o.h1", "o.h2", "o.len")


def rebuilt(turns: DataFrame, shared, most: int, group: int) -> DataFrame:
    """(conv, blk, start, t): units; a conversation takes its first ``shared(conv)`` turns, ``most`` at most, from the first
    conversation of its ``group``, and its own turns after as many."""
    one = F.struct("i", "h1", "h2", "len")
    h = shared(F.col("conv")).cast("long")
    own = turns.withColumn("h", h).where("i >= h").groupBy("conv", F.floor(F.col("i") / BAND).alias("blk")) \
        .agg(F.array_sort(F.collect_list(one)).alias("own"))                                # BAND at most
    convs = turns.select("conv").distinct().withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % group)
    heads = turns.where((F.col("conv") % group == 0) & (F.col("i") < most)).groupBy(F.col("conv").alias("base")) \
        .agg(F.array_sort(F.collect_list(one)).alias("head"))
    none = F.array().cast("array<struct<i:long,h1:long,h2:long,len:long>>")
    head = F.slice(F.coalesce("head", none), 1, F.col("h").cast("int"))
    convs = convs.join(heads, "base", "left").select("conv", "h", head.alias("head"))
    rows = convs.join(own, "conv", "left").select("conv", "h", "head", F.coalesce("blk", F.lit(0)).cast("long").alias("blk"),
                                                  F.coalesce("own", none).alias("own"))
    first = F.col("blk") == 0
    start = F.when(first, 0).otherwise(F.col("blk") * BAND - F.col("h") + F.size("head"))
    return rows.select("conv", "blk", start.cast("long").alias("start"),
                       F.when(first, F.concat("head", "own")).otherwise(F.col("own")).alias("t"))


def keyed(units: DataFrame) -> DataFrame:
    """Units with the key (p1, p2) of the prefix before them, and whether they are their conversation's last."""
    d = units.select("conv", "blk", "start", F.col("t.h1").alias("h1"), F.col("t.h2").alias("h2"), F.col("t.len").alias("len"))

    def run(batches):
        for b in batches:
            lists = {c: b.column(c) for c in ("h1", "h2")}
            offset = lists["h1"].offsets.to_numpy()
            offset, count = offset[:-1] - offset[0], np.diff(offset)
            start = b.column("start").to_numpy()
            depth = np.arange(count.sum()) - np.repeat(offset - start, count) + 1
            sums = []
            for c in ("h1", "h2"):
                run = np.concatenate(([0], np.bitwise_xor.accumulate(mixed(lists[c].flatten().to_numpy(), depth))))
                sums.append(pa.array(run[offset + count] ^ run[offset], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("blk"), *sums], ["conv", "blk", "x1", "x2"])

    d = written(d, "units")
    w = Window.partitionBy("conv").orderBy("blk")
    light = d.mapInArrow(run, longs("conv blk x1 x2"))
    before = light.select("conv", "blk", *[F.coalesce(F.bit_xor(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(p)
                                           for x, p in (("x1", "p1"), ("x2", "p2"))],
                          F.lead("blk").over(w).isNull().cast("long").alias("last"))
    return d.join(before, ["conv", "blk"])


def sharded(units: DataFrame) -> DataFrame:
    """Units with their shard: neighbours in the order of prefixes, about ``SHARD`` turns each."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["start", "p1", "p2", F.slice("h1", 1, 8), "conv", "blk"]

    def run(batches):
        shard, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            size = np.diff(b.column("h1").offsets.to_numpy()) + 1
            no = shard + (held + np.cumsum(size) - size) // SHARD
            held += int(size.sum())
            yield b.append_column("shard", pa.array(no, pa.int64()))

    d = units.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields)
    return written(d.mapInArrow(run, f"{kinds}, shard long"), "shards")


# --- passes over the shards --------------------------------------------------------------------------------------------


def parts(units: DataFrame) -> DataFrame:
    """Per shard and node: its key, its parent's, members there, the smallest, the length of its last text."""
    names = "shard node depth k1 k2 q1 q2 n low len"

    def run(t: pa.Table) -> pa.Table:
        s = Shard(t)
        n, low = np.zeros(len(s.slot), np.int64), np.full(len(s.slot), np.iinfo(np.int64).max)
        for step, units, node in s.walk():
            if not step:
                units, node = units[s.start[units] == 0], node[s.start[units] == 0]     # other prefixes count where they end
            np.add.at(n, node, 1)
            np.minimum.at(low, node, s.conv[units])
        return arrow(names, (np.full(len(n), t.column("shard")[0].as_py()), np.arange(len(n)), s.depth, s.k1, s.k2,
                             s.k1[s.up], s.k2[s.up], n, low, s.last))

    return units.groupBy("shard").applyInArrow(run, longs(names))


def with_known(units: DataFrame, known: DataFrame, one, names: str) -> DataFrame:
    """``one(shard, n, low, kids, table)`` for each shard, with its nodes' global values."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("of_node")
        return arrow(names, one(Shard(left), *(right.column(f"of_{c}").to_numpy() for c in ("n", "low", "kids")), left))

    known = known.select(*[F.col(c).alias(f"of_{c}") for c in ("shard", "node", "n", "low", "kids")])
    return units.groupBy("shard").cogroup(known.groupBy("of_shard")).applyInArrow(run, longs(names))


def owned(s: Shard, n, low, kids, t):
    """Per unit: what its conversation saves by the nodes that it owns there; its last node, and whether it owns that leaf."""
    saved, end = np.zeros(len(s.conv), np.int64), np.zeros(len(s.conv), np.int64)
    for _, units, node in s.walk():
        saved[units] += np.where(low[node] == s.conv[units], (n[node] - 1) * s.last[node], 0)
        end[units] = node
    last = t.sort_by([("conv", "ascending"), ("blk", "ascending")]).column("last").to_numpy()
    leaf = (last == 1) & (kids[end] == 0) & (low[end] == s.conv)
    return s.conv, s.blk, saved, leaf.astype(np.int64), last, s.depth[end], s.k1[end], s.k2[end]


def summed(s: Shard, n, low, kids, t):
    """Per node: its members' savings and leaves, and, where its smallest member is here, what that one owns above the node."""
    t = t.sort_by([("conv", "ascending"), ("blk", "ascending")])
    total, leaf, above = (t.column(c).to_numpy() for c in ("total", "leaf", "prior"))
    above = above.copy()
    saved, leaves, rest = (np.zeros(len(n), np.int64) for _ in range(3))
    for step, units, node in s.walk():
        count = s.start[units] == 0 if not step else np.ones(len(units), bool)
        np.add.at(saved, node[count], total[units][count])
        np.add.at(leaves, node[count], leaf[units][count])
        mine = count & (low[node] == s.conv[units])
        rest[node[mine]] = above[units[mine]]
        above[units[mine]] += (n[node[mine]] - 1) * s.last[node[mine]]
    up = np.where(s.depth == 0, np.iinfo(np.int64).min, low[s.up])
    held = ~s.top | (s.depth == 0)
    return tuple(x[held] for x in (s.depth, s.k1, s.k2, low, up, n, kids, saved, leaves, rest))


def hashed(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha): the digest of the ascending, comma-joined ids of each key; ids are joined by ranges, then streamed."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches):
        held, size = {}, 0

        def flush():
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)] + [pa.array([held[k][0] for k in keys], pa.int64()),
                 pa.array([",".join(map(str, held[k])) for k in keys], pa.string())], [*NODE, "first", "ids"])

        for b in batches:
            for conv, *key in zip(*(b.column(c).to_pylist() for c in ("conv", *NODE))):
                held.setdefault(tuple(key), []).append(conv)
                size += 20
                if size > PIECE:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def digests(batches):
        key, sha, out = None, None, []
        for b in batches:
            for *k, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
                if k == key:
                    sha.update(b"," + ids.encode())
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
            if out:
                yield batch(out)
                out = []
        if key:
            yield batch([(*key, sha.hexdigest())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()])], [*NODE, "sha"])

    joined = ends.repartitionByRange(n, "conv").sortWithinPartitions("conv").mapInArrow(pieces, f"{longs('depth k1 k2 first')}, ids string")
    return joined.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, f"{longs('depth k1 k2')}, sha string")


def prefix_trie(df: DataFrame, shared=lambda c: F.lit(0), most: int = 0, group: int = 1, conv: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = written(numbered(df, conv, turn, role, text), "turns")
    units = sharded(keyed(rebuilt(turns, shared, most, group)))
    part = written(parts(units), "parts")
    nodes = part.where("n > 0").groupBy(*NODE).agg(F.sum("n").alias("n"), F.min("low").alias("low"),
                                                   F.max(F.struct("q1", "q2")).alias("q"))
    nodes = written(nodes, "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q.q1").alias("k1"), F.col("q.q2").alias("k2")) \
        .agg(F.count(F.lit(1)).alias("kids"))
    whole = nodes.join(kids, NODE, "left").select(*NODE, "n", "low", F.coalesce("kids", F.lit(0)).alias("kids"))
    known = written(part.select("shard", "node", *NODE).join(whole, NODE).select("shard", "node", "n", "low", "kids"), "known")
    own = written(with_known(units, known, owned, "conv blk saved leaf last depth k1 k2"), "owned")
    total = own.groupBy("conv").agg(F.sum("saved").alias("total"), F.sum("leaf").alias("leaf"))
    w = Window.partitionBy("conv").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    prior = own.select("conv", "blk", F.coalesce(F.sum("saved").over(w), F.lit(0)).alias("prior"))
    got = with_known(units.join(prior, ["conv", "blk"]).join(total, "conv"), known, summed, "depth k1 k2 low up n kids saved leaves rest")
    got = got.groupBy(*NODE).agg(*[F.max(c).alias(c) for c in ("low", "up", "n", "kids")],
                                 *[F.sum(c).alias(c) for c in ("saved", "leaves", "rest")])
    ends = hashed(own.where("last = 1").select("conv", *NODE))
    return got.join(ends, NODE, "left").select(
        F.col("low").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("up")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("rest")).alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), shared=lambda c: F.crc32(c.cast("string").cast("binary")) % 6,
                       most=5, group=100)


SQL = """
WITH RECURSIVE
convs AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (        -- a bit per round
  SELECT c, CAST(c AS VARCHAR) AS s, 0 AS k, 4294967295 AS v FROM convs
  UNION ALL
  SELECT c, s, k + 1, xor(w >> 1, 3988292384 * (w & 1))
  FROM (SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(s, k // 8 + 1, 1))) ELSE v END AS w FROM crc WHERE k < 8 * length(s))),
heads AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE k = 8 * length(s)),
own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS role,
         coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
built AS (
  SELECT h.c, 0 AS part, o.i, o.role, o.text FROM heads h JOIN own o ON o.c = h.c - h.c % 100 AND o.i < h.h
  UNION ALL SELECT h.c, 1, o.i, o.role, o.text FROM heads h JOIN own o ON o.c = h.c AND o.i >= h.h),
steps AS (
  SELECT c, row_number() OVER w AS d, length(text) AS len, list({'r': role, 't': text}) OVER w AS key
  FROM built WINDOW w AS (PARTITION BY c ORDER BY part, i)),
path AS (SELECT c, 0 AS d, 0 AS len, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]) AS key FROM convs UNION ALL SELECT c, d, len, key FROM steps),
depths AS (SELECT c, max(d) AS d FROM path GROUP BY c),
nodes AS (SELECT key, d, min(c) AS low, count(*) AS n, any_value(len) AS len FROM path GROUP BY key, d),
ends AS (
  SELECT p.key, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM path p JOIN depths USING (c, d) GROUP BY p.key),
kids AS (SELECT key[:d - 1] AS key, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT n.key[:u.i] AS key, sum((n.n - 1) * n.len) AS saved, count(*) FILTER (WHERE k.k IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids k USING (key), LATERAL (SELECT unnest(range(0, n.d + 1)) AS i) u GROUP BY 1)
SELECT n.low AS conv_id, CAST(n.d AS BIGINT) AS depth, p.low AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0) AS n_children,
       b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.key = n.key[:n.d - 1] LEFT JOIN kids k ON k.key = n.key
LEFT JOIN ends e ON e.key = n.key JOIN below b ON b.key = n.key
"""
