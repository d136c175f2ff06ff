"""Exact duplicates: Patricia-trie owners.

Every task first inserts the whole byte strings of its rows, ``CHUNK_BYTES`` at a time, into a compressed radix trie and
passes each different string on once, with the number of its rows and the smallest identifier among them, so a text
that a third of all rows repeat leaves a chunk as one row. These rows are dealt out by (length, content hash), and each
partition inserts their full strings into a trie of its own, whose terminal nodes hold the smallest identifier,
the row count and the chunk rows they stand for. Strings are equal only if all bytes are: they meet in a terminal node.

A trie that grows beyond ``TRIE_BYTES`` spills its heaviest subtrees: their strings go back as rows, strings that
enter a spilled subtree later pass through, and the next round deals these rows over twice as many partitions. Each
round finishes at least one string of each partition, so nothing is dropped at any memory limit.

Identifiers are ordered by ``keep``: for "largest" the order is turned round (``~id``), so the smallest one always stays.

Defined cases: a null text is the empty text; texts count as UTF-8 bytes, unchanged; rows with a null id come after all others,
so one of them stays only if the group has no id at all (keep_id null); of rows with the same id and text one stays; an
empty table gives no rows; a single string beyond the limit is held alone; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veloscope.llm.common import documents, text_or_empty, written

CHUNK_BYTES = 32 << 20      # strings that a task compares among themselves before they are shuffled
TRIE_BYTES = 96 << 20       # strings and nodes that a trie holds before it spills subtrees
NODE_BYTES = 600            # what a string's nodes and owner take besides its bytes

KEPT = "reps array<long>, n long, ord long, row long, sha string, size long, hash long, text binary"


class Node:
    """The edge ``text[start:end]`` that leads here; ``owner``: [text, n, (order key), reps] if a string ends here."""
    __slots__ = ("text", "start", "end", "kids", "owner", "spilled")

    def __init__(self, text: bytes, start: int, end: int):
        self.text, self.start, self.end = text, start, end
        self.kids, self.owner, self.spilled = {}, None, False


def common(a: bytes, i: int, z: int, b: bytes, j: int) -> int:
    """Length of the common prefix of a[i:z] and b[j:]."""
    n, same, step = min(z - i, len(b) - j), 0, 32
    while same < n and a[i + same:i + min(same + step, n)] == b[j + same:j + min(same + step, n)]:
        same, step = min(same + step, n), step * 4
    high = min(same + step, n)
    while high - same > 1:                      # the first difference lies in [same, high)
        mid = (same + high) // 2
        if a[i + same:i + mid] == b[j + same:j + mid]:
            same = mid
        else:
            high = mid
    return same


class Trie:
    def __init__(self):
        self.root, self.bytes = Node(b"", 0, 0), 0

    def find(self, text: bytes) -> Node | None:
        """The node where ``text`` ends, made if need be; None if it belongs to a spilled subtree."""
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text, at, len(text))
                return kid
            if kid.spilled:
                return None
            same = common(kid.text, kid.start, kid.end, text, at)
            if kid.start + same < kid.end:      # part of the edge: a node between, with its own copy of the shared bytes
                mid = Node(kid.text[kid.start:kid.start + same], 0, same)
                kid.start += same
                mid.kids[kid.text[kid.start]] = kid
                node.kids[text[at]] = mid
                kid = mid
            node, at = kid, at + same
        return node

    def insert(self, text: bytes, n: int, key: tuple, reps: list[int]) -> bool:
        """Counts ``n`` rows of ``text``; False if its subtree is spilled."""
        node = self.find(text)
        if node is None:
            return False
        if node.owner is None:
            node.owner = [text, n, key, reps]
            self.bytes += len(text) + NODE_BYTES
        else:
            own = node.owner
            own[1] += n
            own[2] = min(own[2], key)
            own[3] += reps
        return True

    @staticmethod
    def terminals(top: Node):
        stack = [top]
        while stack:
            node = stack.pop()
            if node.owner:
                yield node.owner
            stack.extend(node.kids.values())

    def spill(self, limit: int):
        """Owners of the heaviest subtrees, taken out until half of ``limit`` is left; the first string reached stays."""
        node = self.root
        while self.bytes > limit // 2:
            weight = {b: sum(len(o[0]) + NODE_BYTES for o in self.terminals(k)) for b, k in node.kids.items() if not k.spilled}
            order = sorted(weight, key=weight.get)
            alone = node.owner is None          # no string ends here: the lightest subtree stays
            for b in reversed(order[1:] if alone else order):
                if self.bytes <= limit // 2:
                    return
                yield from self.terminals(node.kids[b])
                stub = Node(bytes([b]), 0, 1)
                stub.spilled, node.kids[b] = True, stub
                self.bytes -= weight[b]
            if not alone or not order:
                return
            node = node.kids[order[0]]


def order_key(order: int | None, row: int) -> tuple:
    return order is None, order or 0, row


def chunks(batches, limit: int):
    """A row per input row (id order, row, rep): rep is the first row of the chunk with its text, which carries the text, the
    chunk's count of it and the smallest (order, row)."""
    trie, rows, held = Trie(), [], 0

    def flush():
        first = {own[3][0]: own for own in trie.terminals(trie.root)}
        heads = [first[i] if i == rep else None for _, i, rep in rows]
        return pa.RecordBatch.from_arrays([
            pa.array([o for o, *_ in rows], pa.int64()), pa.array([i for _, i, _ in rows], pa.int64()),
            pa.array([r for *_, r in rows], pa.int64()), pa.array([h and h[1] for h in heads], pa.int64()),
            pa.array([None if not h or h[2][0] else h[2][1] for h in heads], pa.int64()),
            pa.array([h and h[2][2] for h in heads], pa.int64()), pa.array([h and h[0] for h in heads], pa.binary())],
            ["ord", "row", "rep", "n", "best", "best_row", "text"])

    for b in batches:
        for o, i, text in zip(*(b.column(c).to_pylist() for c in ("ord", "row", "text"))):
            node = trie.find(text)
            if node.owner is None:
                node.owner = [text, 0, order_key(o, i), [i]]
                held += len(text) + NODE_BYTES
            own = node.owner
            own[1] += 1
            own[2] = min(own[2], order_key(o, i))
            rows.append((o, i, own[3][0]))
            held += 100
            if held > limit:
                yield flush()
                trie, rows, held = Trie(), [], 0
    if rows:
        yield flush()


def resolve(batches, limit: int):
    """Owners of a partition's strings (text null); strings of spilled subtrees as they came or merged so far."""
    trie = Trie()

    def out(owners, done):
        owners = list(owners)
        no = [None] * len(owners)
        texts = [o[0] for o in owners]
        return pa.RecordBatch.from_arrays([
            pa.array([o[3] for o in owners], pa.list_(pa.int64())), pa.array([o[1] for o in owners], pa.int64()),
            pa.array([None if o[2][0] else o[2][1] for o in owners], pa.int64()), pa.array([o[2][2] for o in owners], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts] if done else no, pa.string()),
            pa.array(no if done else [o[4] for o in owners], pa.int64()), pa.array(no if done else [o[5] for o in owners], pa.int64()),
            pa.array(no if done else texts, pa.binary())], ["reps", "n", "ord", "row", "sha", "size", "hash", "text"])

    for b in batches:
        passed = []
        for reps, n, o, row, size, h, text in zip(*(b.column(c).to_pylist() for c in ("reps", "n", "ord", "row", "size", "hash", "text"))):
            if not trie.insert(text, n, order_key(o, row), reps):
                passed.append([text, n, order_key(o, row), reps, size, h])
            elif len(own := trie.find(text).owner) == 4:
                own += [size, h]
            if trie.bytes > limit:
                passed += trie.spill(limit)
        if passed:
            yield out(passed, False)
    owners = trie.terminals(trie.root)
    while part := [o for _, o in zip(range(4096), owners)]:
        yield out(part, True)


def owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
           chunk_bytes: int = CHUNK_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, sha): one row per row of ``df``; ``keep``: "smallest" or "largest" identifier."""
    turned = {"smallest": lambda c: c, "largest": F.bitwise_not}[keep]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(turned(F.col(id_col).cast("long")).alias("ord"), F.monotonically_increasing_id().alias("row"),
                  text_or_empty(text_col).cast("binary").alias("text"))
    chunked = written(d.mapInArrow(lambda batches: chunks(batches, chunk_bytes),
                                   "ord long, row long, rep long, n long, best long, best_row long, text binary"), "strings")
    rest = chunked.where("text IS NOT NULL").select(
        F.array("rep").alias("reps"), "n", F.col("best").alias("ord"), F.col("best_row").alias("row"),
        F.lit(None).cast("string").alias("sha"), F.length("text").cast("long").alias("size"), F.xxhash64("text").alias("hash"), "text")
    found, deal = [], 0
    while True:
        by = ["size", "hash"] if not deal else ["size", F.xxhash64("hash", F.lit(deal))]
        got = written(rest.repartition(n << deal, *by).mapInArrow(lambda batches: resolve(batches, trie_bytes), KEPT), "owners")
        found.append(got.where("text IS NULL"))
        rest, deal = got.where("text IS NOT NULL"), deal + 1
        if rest.isEmpty():
            break
    own = found[0]
    for more in found[1:]:
        own = own.unionByName(more)
    own = own.select(F.explode("reps").alias("rep"), F.col("n").alias("group_size"), F.col("ord").alias("best"),
                     F.col("row").alias("best_row"), "sha")
    return chunked.select("ord", "row", "rep").join(own, "rep").select(
        turned(F.col("ord")).alias("id"), turned(F.col("best")).alias("keep_id"), "group_size",
        (F.col("row") == F.col("best_row")).alias("kept"), "sha")


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    d = owners(documents(spark, sf_dir), keep="largest")
    return d.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
