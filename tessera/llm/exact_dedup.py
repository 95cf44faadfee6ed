"""Exact deduplication: Patricia-trie owners over length-and-content-hash partitions.

Stage 1, before any exchange: every input partition inserts its texts' bytes into compressed radix tries, so a
group of copies leaves a partition as one row however large it is. Stage 2: those rows are dealt by (length,
SHA-256) and inserted again into tries; a terminal node adds up the copies and keeps the owner's id, the smallest
or the largest. Equality is decided by the full byte strings in the trie, never by the hash alone. When a
partition's tries hold more than `budget` bytes, the heaviest subtree is spilled to the task's own scratch file and
finished after the rest, so memory is bounded by the budget and one subtree that fits in it (or one text).

Defined cases: null text counts as empty; texts are equal when identical, with no normalisation; a null id never
owns a group unless all its ids are null; repeated rows count each; an empty table gives an empty result; other
columns are neither read nor returned.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width

#: Bytes of labels that one task's tries may hold before a subtree is spilled.
BUDGET = 96 << 20


class Node:
    """edge: the bytes that lead here from the parent; count > 0 marks a terminal node."""

    __slots__ = ("edge", "children", "count", "owner")

    def __init__(self, edge: bytes, count: int = 0, owner: int | None = None):
        self.edge, self.count, self.owner, self.children = edge, count, owner, None


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by doubling blocks and then halving, so long labels compare at memcmp speed."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    def __init__(self, largest: bool = True, budget: int = BUDGET):
        self.largest, self.budget, self.held = largest, budget, 0
        self.roots: dict[int, Node] = {}  # by first byte
        self.empty: Node | None = None
        self.weight: dict[int, int] = {}
        self.spilled: dict[int, object] = {}

    def better(self, new: int | None, old: int | None) -> int | None:
        if new is None or old is None:
            return old if new is None else new
        return max(new, old) if self.largest else min(new, old)

    def add(self, key: bytes, owner: int | None, count: int = 1) -> None:
        if not key:
            if self.empty is None:
                self.empty = Node(b"")
            self.mark(self.empty, owner, count)
            return
        first = key[0]
        if first in self.spilled:
            pickle.dump((key, owner, count), self.spilled[first])
            return
        root = self.roots.get(first)
        if root is None:
            self.roots[first] = Node(key, count, owner)
            self.grow(first, len(key))
            return
        self.insert(first, root, key, owner, count)
        if self.held > self.budget:
            self.spill(max(self.weight, key=self.weight.get))

    def grow(self, first: int, n: int) -> None:
        self.held += n + 200
        self.weight[first] = self.weight.get(first, 0) + n + 200

    def mark(self, node: Node, owner: int | None, count: int) -> None:
        node.owner = owner if node.count == 0 else self.better(owner, node.owner)
        node.count += count

    def insert(self, first: int, node: Node, key: bytes, owner: int | None, count: int) -> None:
        at = 0
        while True:
            rest = key[at:]
            k = shared_prefix(rest, node.edge)
            if k < len(node.edge):  # the label parts here
                lower = Node(node.edge[k:], node.count, node.owner)
                lower.children = node.children
                node.edge, node.count, node.owner, node.children = node.edge[:k], 0, None, {lower.edge[0]: lower}
                self.grow(first, 0)
            at += k
            if at == len(key):
                self.mark(node, owner, count)
                return
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], count, owner)
                self.grow(first, len(key) - at)
                return
            node = child

    def walk(self, root: Node) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(root, root.edge)]
        while stack:
            node, key = stack.pop()
            if node.count:
                yield key, node.owner, node.count
            for child in (node.children or {}).values():
                stack.append((child, key + child.edge))

    def spill(self, first: int) -> None:
        out = tempfile.TemporaryFile()
        for item in self.walk(self.roots.pop(first)):
            pickle.dump(item, out)
        self.held -= self.weight.pop(first)
        self.spilled[first] = out

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        """All terminals, each once; a spilled subtree is read back and split below its common prefix."""
        if self.empty is not None:
            yield b"", self.empty.owner, self.empty.count
        for first in sorted(self.roots):
            yield from self.walk(self.roots[first])
        self.roots, self.weight, self.held = {}, {}, 0
        for first in sorted(self.spilled):
            file = self.spilled[first]
            prefix = None
            for key, _, _ in self.unpickled(file):
                prefix = key if prefix is None else prefix[: shared_prefix(prefix, key)]
            below = PatriciaTrie(self.largest, self.budget)
            for key, owner, count in self.unpickled(file):
                below.add(key[len(prefix):], owner, count)
            file.close()
            for key, owner, count in below.drain():
                yield prefix + key, owner, count

    @staticmethod
    def unpickled(file) -> Iterator[tuple]:
        file.seek(0, os.SEEK_SET)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def batches_of(rows: Iterable[tuple], schema: pa.Schema, most_rows: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[0]) if isinstance(row[0], bytes) else 64
        if len(held) >= most_rows or n >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """One row per distinct text that has copies: len, sha, keep_id, group_size."""
    largest = keep == "largest"
    local = pa.schema([("body", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
    final = pa.schema([("len", pa.int64()), ("body", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def first_pass(batches):
        trie = PatriciaTrie(largest, budget)
        for b in batches:
            for owner, body in zip(b.column(0).to_pylist(), b.column(1)):
                trie.add(body.as_py(), owner)
        yield from batches_of(trie.drain(), local)

    def last_pass(batches):
        trie = PatriciaTrie(largest, budget)
        for b in batches:
            for body, owner, n in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                trie.add(body.as_py(), owner, n)
        yield from batches_of(((len(k), k, o, n) for k, o, n in trie.drain() if n > 1), final)

    bodies = docs.select(F.col(id_col).cast("long").alias("owner"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("body"))
    once = bodies.mapInArrow(first_pass, "body binary, owner long, n long")
    dealt = once.repartition(shuffle_width(docs.sparkSession), F.octet_length("body"), F.sha2("body", 256))
    met = dealt.mapInArrow(last_pass, "len long, body binary, keep_id long, group_size long")
    return met.select("len", F.sha2("body", 256).alias("sha"), "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("len"), F.sha2(body, 256).alias("sha"))
    own = owners(docs, id_col, text_col, keep, budget)
    joined = each.join(own, ["len", "sha"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """docs, columns as they are, with one row of each distinct text.

    The ids that go are found on narrow rows; full rows are dealt by id and hash, so no group of copies meets in a task.
    """
    marked = docs.withColumn("__sha", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    gone = exact_duplicates(docs, id_col, text_col, keep).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__gone")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__gone"))
    return marked.join(gone, same, "left_anti").dropDuplicates([id_col, "__sha"]).select(*docs.columns)


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
