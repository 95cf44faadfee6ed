"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling (DataFrame functions only).

A document is the sequence of its lines that hold a word; a line's id is its hash's place in sorted order, and lines
that occur once end every repeat. Round k ranks each position by its next 2 ** k lines, from the pair of ranks of the
two halves: the suffix array's order by that prefix. A position whose prefix occurs nowhere else leaves; rounds go on
until no repeat is left, at any length.

Longest common prefixes come from the ranks on the way down: each position's common prefix with its nearest suffix
starts as its last power of two and is lengthened by 2 ** j where the longer prefix still occurs twice. Positions with
one such prefix are an interval of the array: a maximal repeated run of lines. Its first position stays, each other
one is a later copy. A first position may still be a later copy of a shorter run, which is seen from the interval of
its first `min_lines` lines, the least run that counts (1 by default). Later copies, merged, go.

Order: by document id, then line. A line without a word is no run of its own: it goes with the line before it, and
leading ones stay. Defined cases: null text counts as empty (one empty line); rows that repeat an id and its text are
one document, so they delete nothing from each other; a null id comes first; an empty table gives an empty result;
other columns are ignored. No group is collected: hot lines meet in partial aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import dropped, shuffle_width, stored

MIN_LINES = 1
AT = ["d", "t", "at"]
HOLDS_WORD = r"[^\x20\x09-\x0D]"


def ranked(groups: DataFrame, keys: list[str], name: str = "r") -> DataFrame:
    """keys with a rank that orders them; groups has a row for each key that occurs more than once."""
    n = shuffle_width(groups.sparkSession)
    return groups.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select(*keys, F.monotonically_increasing_id().alias(name))


def sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, at, line, until, h1, h2) of each line with a word: its place among these, its line, the last wordless line behind it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("t"), F.split(text, "\n", -1).alias("lines"))
    numbered = F.transform("lines", lambda s, i: F.struct(i.alias("line"), s.alias("s")))
    held = cut.select("d", "t", F.size("lines").alias("n"), F.filter(numbered, lambda x: x["s"].rlike(HOLDS_WORD)).alias("held"))
    nexts = held.select("d", "t", "n", "held", F.concat(F.slice(F.transform("held", lambda x: x["line"]), 2, 1 << 30), F.array("n")).alias("next"))
    each = nexts.where(F.size("held") > 0).select("d", "t", F.posexplode(F.arrays_zip("held", "next")).alias("at", "x"))
    s = F.col("x.held.s")
    return each.select(*AT, F.col("x.held.line").alias("line"), (F.col("x.next") - 1).alias("until"), F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"))


def doubled(first: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels and names. Level k: (d, t, at, r), the rank of the 2 ** k lines from each position whose prefix of that
    length occurs elsewhere too; names k: (p, q, r), the ranks of the halves of each rank of level k + 1."""
    levels, names = [first.select(*AT, "r")], []
    while True:
        step = 1 << (len(levels) - 1)
        right = levels[-1].select("d", "t", (F.col("at") - step).alias("at"), F.col("r").alias("q"))
        pairs = stored(levels[-1].withColumnRenamed("r", "p").join(right, AT), "lines-pairs")
        twice = pairs.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        halves = stored(ranked(twice, ["p", "q"]), "lines-names")
        if halves.isEmpty():
            dropped(pairs, halves)
            return levels, names
        levels.append(stored(pairs.join(halves, ["p", "q"]).select(*AT, "r"), "lines-level", after=[pairs]))
        names.append(halves)


def common_prefixes(levels: list[DataFrame], names: list[DataFrame]) -> DataFrame:
    """(d, t, at, m, step, c): m is the longest common prefix with another suffix, (step, c) names the m lines.

    On the way down a prefix is lengthened by 2 ** j lines where the longer one occurs twice. Suffixes that are known to
    have more in common stand by as one row (step, c, x) for all that go on from c with the run x of 2 ** (j + 1) lines.
    """
    top = len(levels) - 1
    at_top = lambda j: (F.lit(1 << j).alias("m"), F.lit(j).alias("step"), F.col("r").alias("c"))
    state, others = levels[top].select(*AT, *at_top(top)), levels[top].where("false").select(F.lit(0).alias("step"), F.col("r").alias("c"), F.col("r").alias("x"))
    for j in reversed(range(top)):
        here = levels[j].select("d", "t", F.col("at").alias("second"), F.col("r").alias("y"))
        tested = stored(state.withColumn("second", F.col("at") + F.col("m")).join(here, ["d", "t", "second"], "left").drop("second"), "lines-tested", after=[state])
        halved = stored(others.join(names[j].select(F.col("r").alias("x"), F.col("p").alias("y"), F.col("q").alias("rest")), "x").select("step", "c", "y", "rest"), "lines-halved", after=[others])
        met = tested.where("y is not null").select("step", "c", "y", F.lit(1).alias("own"), F.lit(1).alias("n")).unionByName(halved.select("step", "c", "y", F.lit(0).alias("own"), F.lit(2).alias("n")))
        runs = stored(met.groupBy("step", "c", "y").agg(F.sum("own").alias("own"), F.sum("n").alias("n")).where("n > 1").select("step", "c", "y", "own", F.monotonically_increasing_id().alias("longer")), "lines-longer")
        grow = runs.where("own > 0").select("step", "c", "y", "longer")
        on = F.col("longer").isNotNull()
        grown = tested.join(grow, ["step", "c", "y"], "left").select(
            *AT, F.when(on, F.col("m") + (1 << j)).otherwise(F.col("m")).alias("m"), F.when(on, F.lit(-1 - j)).otherwise(F.col("step")).alias("step"), F.coalesce("longer", "c").alias("c"))
        entering = levels[j].join(levels[j + 1].select(*AT), AT, "left_anti").select(*AT, *at_top(j))
        state = stored(grown.unionByName(entering), "lines-prefixes", after=[tested])
        moved = halved.join(grow, ["step", "c", "y"]).select(F.lit(-1 - j).alias("step"), F.col("longer").alias("c"), F.col("rest").alias("x"))
        left = runs.select("step", "c", F.col("y").alias("x"))
        more = names[j].select(F.lit(j).alias("step"), F.col("p").alias("c"), F.col("q").alias("x"))
        # what no position can join any more is let go
        others = stored(moved.unionByName(left).unionByName(more).distinct().join(state.select("step", "c").distinct(), ["step", "c"], "left_semi"), "lines-others", after=[halved, runs])
    return state


def least_runs(levels: list[DataFrame], min_lines: int) -> DataFrame:
    """(d, t, at, p, q): the name of the first min_lines lines of each position, by two overlapping ranks."""
    k = min_lines.bit_length() - 1
    if k >= len(levels):
        return levels[0].where("false").select(*AT, F.col("r").alias("p"), F.col("r").alias("q"))
    shift = min_lines - (1 << k)
    left = levels[k].select(*AT, F.col("r").alias("p"))
    return left.withColumn("q", F.col("p")) if not shift else left.join(levels[k].select("d", "t", (F.col("at") - shift).alias("at"), F.col("r").alias("q")), AT)


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """(d, t, start, to): lines of merged later copies; d is the id, t the hash of the text."""
    lines = stored(sequences(docs, id_col, text_col), "lines")
    seen = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(lines.join(ranked(seen, ["h1", "h2"]), ["h1", "h2"]).select(*AT, "line", "until", "r").distinct(), "lines-first", after=[lines])
    levels, names = doubled(first)
    prefixes = common_prefixes(levels, names).where(F.col("m") >= min_lines)
    known = stored(prefixes.join(least_runs(levels, min_lines), AT).select(*AT, "m", "step", "c", "p", "q"), "lines-known", after=[*levels[1:], *names])
    place = F.struct(*AT)
    # intervals are aggregated and written before the join, so that it stands alone and a hot one can be split
    intervals = stored(known.groupBy("step", "c", "p", "q").agg(F.min(place).alias("first")), "lines-intervals")
    least = stored(intervals.groupBy("p", "q").agg(F.min("first").alias("least")), "lines-least")
    starts = stored(intervals.join(least, ["p", "q"]).select("step", "c", "p", "q", "first", "least"), "lines-starts", after=[intervals, least])
    copies = known.join(starts, ["step", "c", "p", "q"]).where(place > F.col("least")).select("d", "t", F.col("at").alias("start"), (F.col("at") + F.when(place > F.col("first"), F.col("m")).otherwise(min_lines) - 1).alias("to"))
    doc = W.partitionBy("d", "t").orderBy("start", "to")
    reach = F.max("to").over(doc.rowsBetween(W.unboundedPreceding, -1))
    opened = copies.distinct().withColumn("new", (F.coalesce(reach, F.lit(-2)) + 1 < F.col("start")).cast("int")).withColumn("island", F.sum("new").over(doc))
    merged = stored(opened.groupBy("d", "t", "island").agg(F.min("start").alias("start"), F.max("to").alias("to")).drop("island"), "lines-runs", after=[known, starts])
    at_line = first.select("d", "t", "at", "line", "until")
    begun = merged.join(at_line.select("d", "t", F.col("at").alias("start"), "line"), ["d", "t", "start"])
    return begun.join(at_line.select("d", "t", F.col("at").alias("to"), "until"), ["d", "t", "to"]).select("d", "t", F.col("line").alias("start"), F.col("until").alias("to"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (start-end of the runs that go, comma-joined), text (what stays)."""
    runs = later_copies(docs, id_col, text_col, min_lines)
    gone = runs.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("start", "to"))).alias("runs"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("d"))
    cut = rows.join(gone, ["d", "t"], "left").select("doc_id", "text", F.split("text", "\n", -1).alias("lines"), "runs")
    # what stays lies between the runs; each gap is one slice, so the work grows with the lines alone
    gaps = F.transform(F.sequence(F.lit(0), F.size("runs")), lambda i: F.struct(
        F.coalesce(F.get("runs", i - 1)["to"] + 1, F.lit(0)).alias("a"), F.coalesce(F.get("runs", i)["start"], F.size("lines")).alias("b")))
    stays = F.flatten(F.transform(gaps, lambda g: F.slice("lines", g["a"] + 1, g["b"] - g["a"])))
    removed = F.aggregate("runs", F.lit(0), lambda a, r: a + r["to"] - r["start"] + 1)
    hit = F.col("runs").isNotNull()
    return cut.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(hit, removed).otherwise(0).cast("long").alias("n_removed"),
        F.when(hit, F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["start"].cast("string"), r["to"].cast("string"))), ",")).otherwise("").alias("removed"),
        F.when(hit, F.array_join(stays, "\n")).otherwise(F.col("text")).alias("text"),
    )
