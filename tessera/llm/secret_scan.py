"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

DataFrame functions only. A text is cut at its matches by one regular-expression replacement with a mark that the
text can't contain; running lengths of the parts are the spans. The models are two first-order Markov chains over
`ALPHABET`, trained by counting character pairs of labelled samples; a run of token characters is a secret when the
log-likelihood ratio of the chains reaches `MARGIN` in all and `PER_PAIR` a pair. Where a run as a whole doesn't, each
stretch of it that does is one, from `LEAST_STRETCH` characters on: the running sum of ratios starts anew where it
comes to zero, and a stretch ends at its top once the sum has fallen by `MARGIN`. So ordinary words that are joined to
a secret don't hide it. Full stops inside a run belong to it. Runs under LEAST_STRETCH (12) characters are not scored, and runs of letters alone
need PER_PAIR_OF_WORDS a pair below WORD_LENGTH (16).

Defined cases: null text counts as empty and has no span; offsets count code points, end exclusive; equal starts are
ordered by kind as listed in KINDS; repeated rows are scanned each; ids may be null; an empty table gives an empty
result; other columns are ignored. Samples that are null or shorter than two characters teach nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds and their patterns, as the contract states them.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs of token characters; full stops stand inside them, not at an end.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_.-]{12})[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-."
#: Parts of a text whose spans are put together at once; even, so that matches stay at odd places.
CHUNK = 256
LEAST_VALUE, MARGIN, PER_PAIR, PRIOR, LEAST_STRETCH = 6, 12.0, 0.45, 0.5, 12
#: Below so many characters, runs of letters alone, which most ordinary words are, need this ratio a pair.
WORD_LENGTH, PER_PAIR_OF_WORDS = 16, 1.6
#: Words of the ordinary sample, joined by rule to identifiers: common ones of programs and of four languages, taken from no corpus.
WORDS = (
    "user name account number order item price total value count index list first last next token key type state time date start end open close read write file path "
    "line text page view data table column row field group member record event service request response handler manager factory builder client server socket buffer "
    "stream cache store queue message channel header footer body content title image button label panel window layout color width height position offset length size "
    "limit range filter sort search find match replace insert update delete create remove configuration application environment development production international "
    "version release build test check error warning debug info success failure session cookie domain address street city country phone email company department "
    "the this that there other another whether through should would with which while where when people because between different government important information "
    "und nicht sich auch werden haben wurde zwischen gesellschaft entwicklung verantwortung geschichte wirtschaft schreiben möglichkeit versicherung wissenschaft "
    "avec pour dans plus cette comme tout gouvernement développement organisation maintenant beaucoup histoire travail toujours nouveaux quelque bureau chevaux "
    "para como pero más este también cuando información administración desarrollo trabajadores siempre ciudad aquella comunicación pequeño"
).split()


def labelled_samples(spark: SparkSession, n: int = 8000) -> DataFrame:
    """(text, random): n strings of each kind, made by rule from hashes; no table is read."""
    i = F.col("id")
    digest = F.sha2(i.cast("string"), 256)
    b64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    forms = [
        F.substring(digest, 1, 40), F.upper(F.substring(digest, 3, 40)), b64, F.upper(F.translate(b64, "+/", "XQ")), F.lower(F.translate(b64, "+/", "xq")),
        F.concat(F.translate(b64, "+/", "-_"), F.substring(b64, 3, 20)), F.concat_ws(".", F.substring(b64, 1, 14), F.substring(b64, 15, 14)),
        F.concat_ws(".", F.translate(F.substring(b64, 1, 18), "+/", "-_"), F.translate(F.substring(b64, 19, 18), "+/", "-_"), F.substring(digest, 1, 16)),
    ]
    random = F.element_at(F.array(*forms), (i % len(forms) + 1).cast("int"))
    words = F.array(*map(F.lit, WORDS))
    draw = lambda k, m: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(m))
    word = lambda k: F.element_at(words, (draw(k, len(WORDS)) + 1).cast("int"))
    digits = lambda k, m: F.lpad(draw(k, 10 ** m).cast("string"), m, "0")
    camel = F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4)))
    mark = F.element_at(F.array(*map(F.lit, "-_/+")), (draw(9, 4) + 1).cast("int"))
    day = F.concat_ws("-", F.concat(F.lit("20"), digits(5, 2)), digits(6, 2), digits(7, 2))
    plain = [
        F.concat_ws("_", word(1), word(2), word(3)), camel, F.concat_ws("-", word(1), word(2), word(3)), F.concat(word(1), word(2), word(3)),
        F.upper(F.concat_ws("_", word(1), word(2))), F.concat_ws("/", word(1), word(2), word(3), F.concat(word(4), (i % 12).cast("string"))),
        F.concat(digits(1, 9), digits(2, 9)), F.concat(day, F.lit("T"), digits(8, 2), F.lit("-"), digits(3, 2), F.lit("-"), digits(4, 2)), F.repeat(mark, (20 + i % 30).cast("int")),
        F.concat_ws("-", F.concat(word(1), digits(2, 2)), F.concat(F.lit("x"), digits(3, 2)), word(4), F.concat(word(5), digits(6, 4)), word(7)),
        F.concat_ws("/", F.lit(""), F.initcap(word(1)), F.concat(F.lit("_"), word(2)), F.concat(word(3), digits(4, 2)), word(5)), F.repeat(F.substring(word(1), 1, 1), (20 + i % 30).cast("int")),
        F.concat_ws(".", word(1), word(2), F.concat(word(3), F.initcap(word(4)))), F.concat_ws(".", F.concat_ws("_", word(1), word(2)), word(3)),
        F.concat_ws(".", digits(1, 2), digits(2, 1), digits(3, 4)), F.concat(word(1), F.lit("."), F.initcap(word(2)), F.lit("-"), digits(4, 1), F.lit("."), digits(5, 2)),
    ]
    ordinary = F.element_at(F.array(*plain), (i % len(plain) + 1).cast("int"))
    base = spark.range(n, numPartitions=1)
    return base.select(random.alias("text"), F.lit(True).alias("random")).unionByName(base.select(ordinary.alias("text"), F.lit(False).alias("random")))


def codes(text: Column) -> Column:
    """Each character's place in ALPHABET, 0 for others."""
    return F.transform(F.split(text, ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)))


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, row by row; at most (1 + len(ALPHABET)) ** 2 counts come to the driver."""
    k = len(ALPHABET) + 1
    c = samples.where(F.length("text") >= 2).select("random", codes(F.col("text")).alias("c"))
    pairs = c.select("random", F.explode(F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda j: F.get("c", j) * k + F.get("c", j + 1))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = [0.0] * (k * k)
    for a in range(k):
        whole = {s: sum(counts.get((s, a * k + b), 0) for b in range(k)) + PRIOR * k for s in (True, False)}
        for b in range(k):
            p = {s: (counts.get((s, a * k + b), 0) + PRIOR) / whole[s] for s in (True, False)}
            out[a * k + b] = round(math.log(p[True] / p[False]), 4)
    return out


NO_STRETCH = "cast(array() as array<struct<from:int,to:int>>)"


def secret_stretches(text: Column, model: list[float], margin: float, per_pair: float) -> Column:
    """array<struct<from, to>> of a run: the whole run, if it is a secret, else its stretches that are."""
    k = len(ALPHABET) + 1
    table = F.array(*map(F.lit, model))
    word = (F.length(text) < WORD_LENGTH) & ~text.rlike("[^A-Za-z]")
    passes = lambda r, pairs: (r >= margin) & (r >= per_pair * pairs) & ((r >= PER_PAIR_OF_WORDS * pairs) | ~word)

    def closed(a: Column) -> Column:
        good = passes(a["top"], a["end"] - a["start"]) & (a["end"] - a["start"] + 1 >= LEAST_STRETCH)
        return F.when(good, F.array_append(a["out"], F.struct(a["start"].alias("from"), (a["end"] + 1).alias("to")))).otherwise(a["out"])

    def step(a: Column, c: Column) -> Column:
        r = F.when(a["last"] < 0, F.lit(0.0)).otherwise(F.get(table, a["last"] * k + c))
        at, run = a["at"] + 1, a["run"] + r
        higher = run > a["top"]
        over = (run <= 0) | (a["top"] - run >= margin)
        return F.struct(
            c.cast("int").alias("last"), at.alias("at"), (a["sum"] + r).alias("sum"), F.when(over, F.lit(0.0)).otherwise(run).alias("run"),
            F.when(over, F.lit(0.0)).when(higher, run).otherwise(a["top"]).alias("top"), F.when(over, at).otherwise(a["start"]).alias("start"),
            F.when(over | higher, at).otherwise(a["end"]).alias("end"), F.when(over, closed(a)).otherwise(a["out"]).alias("out"),
        )

    zero, no = F.lit(0), F.lit(0.0)
    start = F.struct(F.lit(-1).alias("last"), F.lit(-1).alias("at"), no.alias("sum"), no.alias("run"), no.alias("top"), zero.alias("start"), zero.alias("end"), F.expr(NO_STRETCH).alias("out"))
    whole = lambda a: F.array(F.struct(zero.alias("from"), (a["at"] + 1).alias("to")))
    return F.aggregate(codes(text), start, step, lambda a: F.when(passes(a["sum"], a["at"]), whole(a)).otherwise(closed(a)))


def spans(text: Column, kind: int, pattern: str, within) -> Column:
    """array<struct<start, kind, end>> of what within(match), array<struct<from, to>>, holds of the leftmost non-overlapping matches."""
    mark = "\x01"
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(mark + "$0" + mark)), mark, -1)
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    moved = lambda hits, by: F.transform(hits, lambda h: F.struct((by + h["start"]).alias("start"), h["kind"].alias("kind"), (by + h["end"]).alias("end")))
    spans_of = lambda x: F.transform(within(x), lambda h: F.struct(h["from"].alias("start"), F.lit(kind).alias("kind"), h["to"].alias("end")))
    # positions run on over chunks of parts, and over the chunks: appending one by one would copy what is there each time
    seen = lambda chunk: F.transform(chunk, lambda x, i: F.struct(F.when(i % 2 == 1, spans_of(x)).otherwise(none).alias("hits"), F.length(x).alias("n")))
    add = lambda acc, s: F.struct(
        (acc["at"] + s["n"]).alias("at"), F.when(F.size(s["hits"]) > 0, F.concat(acc["out"], moved(s["hits"], acc["at"]))).otherwise(acc["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    within_chunk = lambda chunk: F.aggregate(seen(chunk), start, add)
    in_chunks = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(CHUNK)), lambda at: within_chunk(F.slice(p, at + 1, CHUNK)))
    join = lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.array_append(acc["out"], moved(c["out"], acc["at"])).alias("out"))
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,kind:int,end:int>>>)").alias("out"))
    found = F.transform(F.array(parts), lambda p: F.flatten(F.aggregate(in_chunks(p), first, join, lambda acc: acc["out"])))[0]
    return F.when(text.rlike(pattern), found).otherwise(none)


def written(found: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, per_pair: float = PER_PAIR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "\x01", "\x02")
    yes = lambda x: F.array(F.struct(F.lit(0).alias("from"), F.length(x).alias("to")))
    secret = lambda x: secret_stretches(x, model, margin, per_pair)
    long = lambda x: F.when(F.length(F.regexp_extract(x, ASSIGN, 2)) >= LEAST_VALUE, yes(x)).otherwise(F.expr(NO_STRETCH))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        spans(F.col("t"), 0, ASSIGN, long).alias("a"),
        spans(F.col("t"), 1, ACCESS, yes).alias("k"),
        spans(F.col("t"), 2, HEX, yes).alias("h"),
        spans(F.col("t"), 3, TOKEN, secret).alias("m"),
    )
    size = lambda c: F.size(c).cast("long")
    return found.select(
        "doc_id", size("a").alias("n_assign"), size("k").alias("n_access"), size("h").alias("n_hex"),
        F.sha2(written(F.concat("a", "k", "h")), 256).alias("base_sha256"), written(F.concat("a", "k", "h", "m")).alias("spans"), size("m").alias("n_markov"),
    )


def scan_with_own_model(docs: DataFrame) -> DataFrame:
    return scan(docs, fit(labelled_samples(docs.sparkSession)))
