"""N-gram Jaccard join with set-relation skipping.

A document is the set of its distinct word shingles, kept as 64-bit hashes; equal sets are one class, so copies cost
one row. Classes are indexed by prefixes in one global order, rare shingles first (shingles that no partition saw
often go by hash, the `heavy` most frequent ones come last), which is right for any order and keeps lists short.

Index level: a list is sorted by size, then position. Lists up to SHORT give all pairs that size and position
allow. A longer list gives each member its pairs with a few leaders and with its neighbour; once these are verified
and joined, only pairs over different components are still open, and its blocks are skipped by their sizes and least
positions.

Answer level: what leaders have in common with their members is known then. For x, y with leader z

    |x & y| <= min(|x & z|, |y & z|) + min(|x - z|, |y - z|)

so most open pairs of two members of a leader's surroundings are answered without reading their sets; the rest is
verified. No candidate is capped or dropped: a list's pairs are emitted, answered by a bound, or known to be joined.

Links: linked sets share a component, so each component's classes are dealt over blocks of about LINK_BLOCK, and each
pair of blocks meets once, in one task, where all its intersections are sparse matrix products. A task returns each
class's number of links, weighted by the partners' documents, not the pairs.

Defined cases: null text counts as empty; a document without words has no set, links with nothing and is its own
component; with fewer words than a shingle the whole sequence is one; repeated rows fall into one class; null ids
never name a component unless alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import shuffle_width, slices, stored
from .components import components

HEAVY, SHORT, LEADERS, BLOCK = 1 << 19, 16, 6, 64
ROUNDS, ROUND_LEADERS = 1, 48
#: How many common shingles two prefixes, this much longer, must show before the full sets are read.
SHOWN = 16
LINK_BLOCK, LINK_VALUES = 256, 1 << 13
FLUSH = 1 << 22
ENTRIES_A_PART = 1 << 19
BLOOM_BITS = 1 << 23
SPACES = " \t\n\x0b\x0c\r"
MULTIPLIERS = np.random.default_rng(4).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class Sets:
    """The shingle sets of a run of texts: values sorted within each text; text i has values[edge[i]:edge[i + 1]]."""

    __slots__ = ("values", "edge", "owner", "cid")

    def __init__(self, words: wordhash.Words, n_texts: int, width: int):
        first, h = words.first, words.hash
        n = np.diff(first)
        with np.errstate(over="ignore"):
            if len(h) >= width:
                grams = sum((h[k:len(h) - width + 1 + k] * MULTIPLIERS[k] for k in range(1, width)), h[:len(h) - width + 1] * MULTIPLIERS[0])
                text = np.repeat(np.arange(n_texts), n)[:len(grams)]
                whole = np.arange(len(grams)) + width <= first[1:][text]
                grams, text = wordhash.mixed(grams[whole]), text[whole]
            else:
                grams, text = h[:0], np.zeros(0, np.int64)
            few = np.flatnonzero((n > 0) & (n < width))
            if len(few):
                short = [wordhash.mixed(np.array([np.sum(h[first[i]:first[i + 1]] * MULTIPLIERS[:n[i]]) + np.uint64(n[i]) * MULTIPLIERS[-1]]))[0] for i in few]
                grams, text = np.concatenate([grams, np.array(short, np.uint64)]), np.concatenate([text, few])
            order = np.lexsort((grams, text))
            grams, text = grams[order], text[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
            self.values, self.owner = grams[new], text[new]
            self.edge = np.searchsorted(self.owner, np.arange(n_texts + 1))
            size = np.diff(self.edge)
            sums = np.zeros(len(self.values) + 1, np.uint64)
            np.cumsum(wordhash.mixed(self.values ^ MULTIPLIERS[-2]), out=sums[1:])
            self.cid = wordhash.mixed((sums[self.edge[1:]] - sums[self.edge[:-1]]) * MULTIPLIERS[-3] + size.astype(np.uint64)).astype(np.int64)

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.edge)


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, int, Sets]]:
    for at, n, words in wordhash.chunks(column, SPACES, fold_case=True):
        yield at, n, Sets(words, n, width)


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n > 0, n + (-num * n) // den + 1, 0)


def needed(a, b, num: int, den: int):
    """The least intersection of sets of a and b elements that reaches num / den."""
    return -((-num * (a + b)) // (num + den))


def ordered(sets: Sets, keys: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text in the global order, often-seen ones last, and their positions."""
    at = np.minimum(np.searchsorted(keys, sets.values), max(0, len(keys) - 1))
    rank = np.where(keys[at] == sets.values, seen[at], 0) if len(keys) else np.zeros(len(sets.values), np.int64)
    order = np.lexsort((sets.values, rank, sets.owner))
    return sets.values[order], np.arange(len(order)) - np.repeat(sets.edge[:-1], sets.size)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def described(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, n, cid) of all documents, and rows (key, seen) of shingles that a run of texts holds often."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("key", pa.int64()), ("seen", pa.int64())])

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, seen = np.unique(np.concatenate(held), return_counts=True)
        keys, seen = keys[seen > 1].astype(np.int64), seen[seen > 1]
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(keys), pa.array(seen, pa.int64())], schema=schema)

    def run(batches):
        held, n_held, known = [], 0, set()
        for b in slices(batches):
            for at, n, sets in sets_of(b.column(1), width):
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(sets.size, pa.int64()), pa.array(sets.cid), none, none], schema=schema)
                fresh = np.array([not (c in known or known.add(c)) for c in sets.cid.tolist()], bool)  # copies count once
                held.append(sets.values[fresh[sets.owner]])
                n_held += len(held[-1])
                if n_held > FLUSH:
                    yield often(held)
                    held, n_held, known = [], 0, set()
        if held:
            yield often(held)

    return docs.mapInArrow(run, "doc_id long, n long, cid long, key long, seen long")


def indexed(docs: DataFrame, width: int, num: int, den: int, keys: np.ndarray, seen: np.ndarray, parts: int) -> DataFrame:
    """(part, entries): the prefixes' entries (key, cid, size << 32 | position), as blocks of three columns for each part."""
    schema = pa.schema([("part", pa.int32()), ("entries", pa.binary())])

    def dealt(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held, axis=1)
        part = (rows[0] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rows, part = rows[:, order], part[order]
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(part)]):
            yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), pa.array([np.ascontiguousarray(rows[:, a:b]).tobytes()], pa.binary())], schema=schema)

    def run(batches):
        held, n_held, known = [], 0, set()
        for b in slices(batches):
            for _, _, sets in sets_of(b.column(1), width):
                size = sets.size
                values, position = ordered(sets, keys, seen)
                fresh = np.array([not (c in known or known.add(c)) for c in sets.cid.tolist()], bool)
                inside = (position < np.repeat(prefix_length(size, num, den), size)) & fresh[sets.owner]
                owner = sets.owner[inside]
                held.append(np.stack([values[inside], sets.cid[owner].astype(np.uint64), size[owner].astype(np.uint64) << np.uint64(32) | position[inside].astype(np.uint64)]))
                n_held += held[-1].shape[1]
                if n_held > FLUSH // 4:
                    yield from dealt(held)
                    held, n_held, known = [], 0, set()
        if held:
            yield from dealt(held)

    return docs.mapInArrow(run, "part int, entries binary")


def possible(sa, pa_, sb, pb, num: int, den: int):
    """Whether sets of these sizes, whose first common element stands at these positions, can reach num / den."""
    return (num * np.maximum(sa, sb) <= den * np.minimum(sa, sb)) & (1 + np.minimum(sa - pa_ - 1, sb - pb - 1) >= needed(sa, sb, num, den))


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("cid", pa.int64()), ("size", pa.int64()), ("position", pa.int64())])


def first_pairs(blobs: list[bytes], num: int, den: int) -> pa.Table:
    """All pairs of short lists; leaders' and neighbours' pairs of long ones, and the long lists' entries."""
    rows = np.concatenate([np.frombuffer(x, np.uint64).reshape(3, -1) for x in blobs], axis=1)
    order = np.lexsort((rows[1], rows[2] >> np.uint64(32), rows[0]))
    key, cid, place = rows[:, order]
    cid, size, pos = cid.astype(np.int64), (place >> np.uint64(32)).astype(np.int64), (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
    one = np.ones(len(key), bool)
    one[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])  # a class may come from several tasks
    key, cid, size, pos = key[one], cid[one], size[one], pos[one]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    length = np.diff(np.append(begin, len(key)))
    of = np.repeat(length, length)
    shared = of > 1
    key, cid, size, pos, of = key[shared], cid[shared], size[shared], pos[shared], of[shared]
    found = []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        ok = (key[i] == key[j]) & (cid[i] != cid[j]) & possible(size[i], pos[i], size[j], pos[j], num, den)
        a, b = cid[i[ok]], cid[j[ok]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))

    if len(key):
        rest = np.flatnonzero(of <= SHORT)
        for step in range(1, SHORT):
            i = rest[rest + step < len(key)]
            i = i[key[i] == key[i + step]]
            if not len(i):
                break
            add(i, i + step)
    long = of > SHORT
    key, cid, size, pos = key[long], cid[long], size[long], pos[long]
    if len(key):
        i = np.arange(len(key) - 1)
        add(i, i + 1)
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(starts) - 1
        order = np.lexsort((wordhash.mixed(cid.astype(np.uint64)), group))
        starts = np.flatnonzero(starts)
        for k in range(LEADERS):
            add(order[starts + k][group], np.arange(len(key)))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    none = lambda n: pa.nulls(n, pa.int64())
    n, m = len(pairs), len(key)
    head = pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none(n), none(n), none(n), none(n)], schema=PAIRS)
    tail = pa.table([none(m), none(m), pa.array(key.astype(np.int64)), pa.array(cid), pa.array(size), pa.array(pos)], schema=PAIRS)
    return pa.concat_tables([head, tail])


def leaders_pairs(table: pa.Table, turn: int, num: int, den: int) -> np.ndarray:
    """Of one long list, the pairs of members outside its largest component with this turn's leaders inside it."""
    cid, size, pos, comp = (table[c].to_numpy() for c in ("cid", "size", "position", "component"))
    names, code, n = np.unique(comp, return_inverse=True, return_counts=True)
    inside, outside = np.flatnonzero(code == n.argmax()), np.flatnonzero(code != n.argmax())
    order = np.argsort(wordhash.mixed(cid[inside].astype(np.uint64) ^ MULTIPLIERS[10 + turn]), kind="stable")[:ROUND_LEADERS]
    out = []
    for i in inside[order].tolist():
        j = outside[possible(size[i], pos[i], size[outside], pos[outside], num, den)]
        out.append(np.stack([np.minimum(cid[j], cid[i]), np.maximum(cid[j], cid[i])], 1))
    return np.concatenate(out)


def open_pairs(table: pa.Table, num: int, den: int) -> np.ndarray:
    """Of one long list, the pairs over different components that neither size, position nor a leader rules out."""
    t = table.sort_by([("size", "ascending"), ("position", "ascending")])
    cid, size, pos, comp = (t[c].to_numpy() for c in ("cid", "size", "position", "component"))
    leaders = [dict(zip(z or [], o or [])) for z, o in zip(t["leaders"].to_pylist(), t["overlaps"].to_pylist())]
    blocks = [(at, min(at + BLOCK, len(cid))) for at in range(0, len(cid), BLOCK)]
    least = np.array([pos[a:b].min() for a, b in blocks])
    same = np.array([comp[a] if (comp[a:b] == comp[a]).all() else 0 for a, b in blocks])
    mixed = np.array([not (comp[a:b] == comp[a]).all() for a, b in blocks])
    out = []
    for i in range(len(cid) - 1):
        last = int(np.searchsorted(size, den * size[i] // num, side="right"))
        for k in range((i + 1) // BLOCK, (last + BLOCK - 1) // BLOCK):
            a, b = blocks[k]
            a, b = max(a, i + 1), min(b, last)
            if a >= b or (not mixed[k] and same[k] == comp[i]):
                continue
            if 1 + min(size[i] - pos[i] - 1, size[b - 1] - least[k] - 1) < needed(size[i], size[a], num, den):
                continue
            j = np.arange(a, b)
            j = j[(comp[j] != comp[i]) & possible(size[i], pos[i], size[j], pos[j], num, den)]
            for y in j.tolist():
                bound = min((min(o, leaders[y][z]) + min(size[i] - o, size[y] - leaders[y][z]) for z, o in leaders[i].items() if z in leaders[y]), default=size[i])
                if bound >= needed(size[i], size[y], num, den):
                    out.append((min(cid[i], cid[y]), max(cid[i], cid[y])))
    return np.array(out, np.int64).reshape(-1, 2)


def bits_of(cid: np.ndarray, k: int) -> np.ndarray:
    return ((wordhash.mixed(cid.astype(np.uint64) ^ MULTIPLIERS[k]) >> np.uint64(8)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def bloom_words(ids: DataFrame) -> np.ndarray:
    """A bit array of fixed size with two bits set for each id; what comes to the driver is bounded by it."""

    def run(batches):
        for b in batches:
            found = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            bit = np.unique(np.concatenate([bits_of(found, k) for k in (1, 2)]))
            yield pa.RecordBatch.from_arrays([pa.array(bit)], ["bit"])

    words = ids.mapInArrow(run, "bit long").groupBy(F.expr("bit div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("m"))
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    found = words.toArrow()
    out[found["w"].to_numpy()] = found["m"].to_numpy().astype(np.uint64)
    return out


def sets_for(docs: DataFrame, each: DataFrame, width: int, ids: DataFrame, head=None) -> DataFrame:
    """(cid, n, grams): size and set of at least the classes in ids, from one document each; with head, of the set
    only the values for which head(sets) says so.

    A class's document is the one with its smallest id; the filter may let others through, whose rows only repeat.
    Documents without an id pass when any class has no other.
    """
    first = each.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first")).join(ids.distinct(), "cid", "left_semi")
    marks = bloom_words(first.select("first"))
    nameless = not first.where("first is null").isEmpty()

    def run(batches):
        for b in slices(batches):
            doc = b.column(0)
            known = doc.is_valid().to_numpy(zero_copy_only=False)
            ok = known.copy()
            value = doc.fill_null(0).to_numpy()
            for k in (1, 2):
                bit = bits_of(value, k)
                ok &= (marks[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ok |= ~known & nameless
            if not ok.any():
                continue
            for _, _, sets in sets_of(b.column(1).filter(pa.array(ok)), width):
                rows = np.flatnonzero(sets.size > 0).tolist()
                values, inside = head(sets) if head else (sets.values, np.ones(len(sets.values), bool))
                grams = [values[a:b][inside[a:b]].astype(np.int64) for a, b in ((sets.edge[i], sets.edge[i + 1]) for i in rows)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(sets.cid[rows]), pa.array(sets.size[rows]), pa.array(grams, pa.list_(pa.int64()))], ["cid", "n", "grams"])

    return docs.mapInArrow(run, "cid long, n long, grams array<long>")


def prefix_of(keys: np.ndarray, seen: np.ndarray, num: int, den: int):
    def head(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
        values, position = ordered(sets, keys, seen)
        return values, position < np.repeat(prefix_length(sets.size, num, den) + SHOWN - 1, sets.size)

    return head


def shown(prefixes: DataFrame, pairs: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """The pairs whose prefixes have as many values in common as sets that similar must have there.

    Two sets with an overlap of o agree in at least min(o, k) of their first n - o + k values, for any k.
    """
    side = lambda x: prefixes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("grams").alias(f"g{x}"))
    least = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.size(F.array_intersect("ga", "gb")) >= F.least(F.lit(SHOWN), least))
    return stored(met.select("a", "b").distinct(), name)


def verified(sets: DataFrame, pairs: DataFrame, num: int, den: int, name: str) -> DataFrame:
    """(a, b, na, nb, both, linked) of each pair, from the full sets."""
    met = (
        pairs.join(sets.select(F.col("cid").alias("a"), F.col("grams").alias("ga")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("grams").alias("gb")), "b")
        .select("a", "b", F.size("ga").cast("long").alias("na"), F.size("gb").cast("long").alias("nb"), F.size(F.array_intersect("ga", "gb")).cast("long").alias("both"))
    )
    return stored(met.distinct().withColumn("linked", F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num), name)


def still_apart(long: DataFrame, comp: DataFrame) -> DataFrame:
    """The entries of long lists that hold more than one component, with the component of each."""
    placed = long.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    split = placed.groupBy("key").agg((F.min("component") != F.max("component")).alias("open")).where("open").select("key")
    return stored(placed.join(split, "key"), "apart")


def nearest_answers(sure: DataFrame) -> DataFrame:
    """(cid, leaders, overlaps): of each class the verified pairs with most in common."""
    both_ways = sure.select(F.col("a").alias("cid"), F.col("b").alias("z"), "both").unionByName(sure.select(F.col("b").alias("cid"), F.col("a").alias("z"), "both"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("both", "z")), False), 1, 8)
    ranked = both_ways.groupBy("z").agg(F.count(F.lit(1)).alias("met")).where("met > 1").select("z")  # a leader is met by several
    return both_ways.join(ranked, "z", "left_semi").groupBy("cid").agg(best.alias("best")).select("cid", F.col("best.z").alias("leaders"), F.col("best.both").alias("overlaps"))


def heaviest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and how often each was seen, of the most frequent keys: all from a count on that leaves at most `most`."""
    per_key = stored(counts.groupBy("key").agg(F.sum("seen").alias("seen")), "heavy")
    level = F.floor(F.log2("seen") * 16)
    levels = per_key.groupBy(level.alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("s")).collect()
    least, left = None, most
    for row in levels:  # at most 16 * 63 rows
        left -= row["n"]
        if left < 0:
            break
        least = row["s"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = per_key.where(level >= least).toArrow()
    keys, seen = top["key"].to_numpy().astype(np.uint64), top["seen"].to_numpy()
    order = np.argsort(keys)
    return keys[order], seen[order]


def met_leaders(turn: int, num: int, den: int):
    def run(table):
        out = leaders_pairs(table, turn, num, den)
        return pa.table([pa.array(out[:, 0], pa.int64()), pa.array(out[:, 1], pa.int64())], names=["a", "b"])

    return run


def met_all(num: int, den: int):
    def run(table):
        out = open_pairs(table, num, den)
        return pa.table([pa.array(out[:, 0], pa.int64()), pa.array(out[:, 1], pa.int64())], names=["a", "b"])

    return run


def overlaps(values: np.ndarray, edge: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The intersections of the sets x with the sets y; set i is values[edge[i]:edge[i + 1]]."""
    held = [np.concatenate([values[edge[i]:edge[i + 1]] for i in rows.tolist()]) for rows in (x, y)]
    owner = [np.repeat(np.arange(len(rows)), edge[rows + 1] - edge[rows]) for rows in (x, y)]
    shared = np.intersect1d(*held)
    out = np.zeros((len(x), len(y)))
    if not len(shared):
        return out
    code = [np.searchsorted(shared, v) for v in held]
    inside = [shared[np.minimum(c, len(shared) - 1)] == v for c, v in zip(code, held)]
    for at in range(0, len(shared), LINK_VALUES):
        sides = []
        for rows, o, c, ok in zip((x, y), owner, code, inside):
            now = ok & (c >= at) & (c < at + LINK_VALUES)
            side = np.zeros((len(rows), min(LINK_VALUES, len(shared) - at)), np.float32)
            side[o[now], c[now] - at] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out


def met_blocks(num: int, den: int):
    def run(key, table):
        _, lo, hi = (k.as_py() for k in key)
        _, once = np.unique(table["cid"].to_numpy(), return_index=True)  # a set may have been read from several documents
        t = table.take(pa.array(once)).combine_chunks()
        cid, comp, m, block = (t[c].to_numpy() for c in ("cid", "component", "m", "block"))
        grams = t["grams"].combine_chunks()
        values, edge = grams.flatten().to_numpy(), np.concatenate([[0], np.cumsum(grams.value_lengths().to_numpy())])
        size, links = np.diff(edge), np.zeros(len(cid), np.int64)
        order = np.argsort(comp, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], comp[order][1:] != comp[order][:-1]]))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)]):
            rows = order[a:b]
            x, y = rows[block[rows] == lo], rows[block[rows] == hi]
            if not len(x) or not len(y):
                continue
            both = overlaps(values, edge, x, y).astype(np.int64)
            linked = (both > 0) & (both * den >= (size[x][:, None] + size[y] - both) * num)
            if lo == hi:
                np.fill_diagonal(linked, False)
            else:
                links[y] += linked.T @ m[x]
            links[x] += linked @ m[y]
        return pa.table([pa.array(cid), pa.array(links)], names=["cid", "links"])

    return run


def link_counts(each: DataFrame, comp: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(cid, n_links): with how many other documents each document of a class links."""
    weights = stored(each.where("n > 0").groupBy("cid").agg(F.count(F.lit(1)).alias("m")), "class-sizes")
    comp = stored(comp.withColumnRenamed("node", "cid"), "members")
    sized = stored(comp.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(LINK_BLOCK)).alias("blocks")), "component-sizes")
    buckets = max(shuffle_width(comp.sparkSession), comp.count() // (4 * LINK_BLOCK))
    members = stored(comp.join(sized, "component").select("cid", "component", "blocks"), "members").join(weights, "cid")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = sets.select("cid", "grams").join(members, "cid").withColumn("block", F.pmod(F.xxhash64("cid"), "blocks")).withColumn("other", other)
    run = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component"))  # small components share a group
    met = dealt.select(run.alias("run"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "cid", "component", "m", "block", "grams")
    found = met.groupBy("run", "lo", "hi").applyInArrow(met_blocks(num, den), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))
    return stored(weights.join(found, "cid", "left").select("cid", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "link-counts")


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100, heavy: int = HEAVY, count_links: bool = False,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and with count_links n_links, the number of other
    documents it links with. Links: intersection / union >= num / den."""
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col)
    known = stored(described(texts, width), "sets")
    each = known.where("n is not null").select("doc_id", "n", "cid")
    keys, seen = heaviest(known.where("key is not null"), heavy)
    entries = each.agg(F.sum(F.col("n") * (den - num) / den + 1)).first()[0] or 0
    parts = max(shuffle_width(spark), int(entries / ENTRIES_A_PART))
    blobs = indexed(texts, width, num, den, keys, seen, parts)

    def listed(table):
        return first_pairs(table["entries"].to_pylist(), num, den)

    found = stored(blobs.groupBy("part").applyInArrow(listed, "a long, b long, key long, cid long, size long, position long"), "pairs")
    pairs = found.where("a is not null").select("a", "b").distinct()
    long = found.where("key is not null").select("key", "cid", "size", "position")
    both = lambda p: p.select(F.explode(F.array("a", "b")).alias("cid"))
    prefixes = stored(sets_for(texts, each, width, both(pairs), prefix_of(keys, seen, num, den)), "prefixes")
    pairs = shown(prefixes, pairs, num, den, "shown")
    sets = stored(sets_for(texts, each, width, both(pairs)), "grams")
    sure = verified(sets, pairs, num, den, "verified")
    comp = components(sure.where("linked").select("a", "b"), "jaccard-components")
    apart = still_apart(long, comp)
    of_long = None
    for turn in range(ROUNDS + 1):
        if apart.isEmpty():
            break
        if of_long is None:
            of_long = stored(sets_for(texts, each, width, apart.select("cid")), "grams-long")
        if turn < ROUNDS:
            asked = apart.groupBy("key").applyInArrow(met_leaders(turn, num, den), "a long, b long")
        else:  # what is open now is answered by bounds or verified, all of it
            asked = apart.join(nearest_answers(sure), "cid", "left").groupBy("key").applyInArrow(met_all(num, den), "a long, b long")
        new = verified(of_long, asked.distinct().join(sure.select("a", "b"), ["a", "b"], "left_anti"), num, den, "verified")
        sure = sure.unionByName(new)
        if new.where("linked").isEmpty():
            continue  # nothing was joined: what is apart stays so
        comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new.where("linked").select("a", "b")), "jaccard-components")
        if turn < ROUNDS:
            apart = still_apart(long, comp)
    placed = each.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("component", "cid")))
    # written first, so that the join below stands alone and a hot component can be split
    least = stored(placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    out = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")]
    if not count_links:
        return placed.join(least, "root", "left").select(*out)
    counts = link_counts(each, comp, sets if of_long is None else sets.unionByName(of_long), num, den)
    named = stored(placed.join(least, "root", "left").select("cid", *out), "named")
    return named.join(counts, "cid", "left").select("doc_id", "n_shingles", "component_id", F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links"))
