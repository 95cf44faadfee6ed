"""Cross-tokenizer alignment, relational: two tokenizers' tokens are joined where they end at the same byte.

Texts are dealt over blocks of about BLOCK_BYTES, and a block's equal segments (segments.py), across which no token of
either side reaches, are aligned once: a block's distinct segments on end are the text that is aligned. An Arrow function
gives it as two lists of tokens and of the bytes they end at. Spark explodes the ends over a table bucketed by block, so
that nothing of a block is shuffled; an equi-join on block and end gives the links, which are the cuts between groups. A
block's pairs of ids, each once with the number of its links, are counted over the corpus and joined back to it. A document
is its segments in order, which lie with it in its block's row: an Arrow function adds up its segments' links and writes
its groups, whole arrays at once. Nothing but blocks, of a bounded size, and counts of pairs of ids is ever gathered.

Defined cases: null and empty texts, and texts whose tokens' bytes don't give the text again, have no tokens and give
zeros; the strings of special tokens in a text are plain text; repeated rows are rows of their own; null ids are kept;
an empty table gives an empty result; other columns are ignored. A text longer than a block is a block of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import on_disk, shared_dir, shuffle_width, stored
from .segments import BATCH_BYTES, Table, balanced, one_thread, segment_counts

#: A token is held as id * WIDTH + byte length; tokens of the public vocabularies have up to 128 bytes.
WIDTH = 256
#: A pair of ids is held as a's id * IDS + b's id.
IDS = 1 << 20
#: Bytes of the texts of a block, and how many pairs of ids may be sent to each executor at once; more are shuffled.
BLOCK_BYTES, SENT_PAIRS = 5 << 19, 500_000
#: Buckets for each of the session's shuffle partitions, so that a task holds few blocks; links, and segments of documents, that are written at once.
SPREAD, SEGMENTS = 8, 1 << 16
#: A worker's table of segments, with both sides' tokens, starts anew beyond so many characters.
TABLE_CHARS = 3 << 23
#: Such segments on end have a boundary between each two; so many are encoded as one text.
INNER, TOGETHER = re.compile(r" [!-~À-ɏ](?:.*[!-~À-ɏ])?", re.DOTALL), 256


def runs_of(segments: list[str]) -> Iterator[list[str]]:
    """The segments in order, in lists that may be encoded as one text."""
    run = []
    for s in segments:
        inner = INNER.fullmatch(s)
        if run and (not inner or len(run) == TOGETHER):
            yield run
            run = []
        if inner:
            run.append(s)
        else:
            yield [s]
    if run:
        yield run


def public_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable Latin ones for themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Ids and bytes of the tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        letters, vocabulary = byte_alphabet(), self.tokenizer.get_vocab()
        self.bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """texts as they are."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Ids and bytes of the pieces of a sentencepiece model, which puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(self.model.get_piece_size())
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in every)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """texts that begin with the space that the model adds."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


class Side:
    """Tokens of numbered segments, on end."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.length = np.array([len(b) for b in tokenizer.bytes], np.int64)
        if self.length.max() >= WIDTH:
            raise ValueError("a token of this vocabulary is too long")
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 14, np.int32), 0
        self.begin, self.count, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def packed(self, ids: list[int]) -> np.ndarray:
        found = np.array(ids, np.int64)
        return (found * WIDTH + self.length[found]).astype(np.int32)

    def told(self, runs: list[list[str]]) -> Iterator[tuple[np.ndarray, list[int], bool]]:
        """Tokens of some segments, how many each of them has, and whether the tokens' bytes give the segments again."""
        texts = ["".join(run) for run in runs]
        for ids, run, text in zip(self.tokenizer.encode(texts), runs, texts):
            found, whole = self.packed(ids), self.joined(ids) == text.encode()
            if len(run) == 1:
                yield found, [len(ids)], whole
                continue
            ends, upto = np.cumsum(found & (WIDTH - 1)), np.cumsum([len(x.encode()) for x in run])
            after = np.searchsorted(ends, upto) + 1
            if whole and np.array_equal(ends[after - 1], upto):
                yield found, np.diff(after, prepend=0).tolist(), True
            else:
                yield from self.told([[x] for x in run])

    def learn(self, segments: list[str]) -> np.ndarray:
        """Takes the segments in; says which of them their tokens' bytes give again."""
        every, count, whole = [np.zeros(0, np.int32)], [], []
        for found, counts, same in self.told(list(runs_of(segments))):
            every.append(found)
            count += counts
            whole += [same] * len(counts)
        flat, count = np.concatenate(every), np.array(count, np.int64)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(count) > len(self.count):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.flat[self.used:self.used + len(flat)] = flat
        self.count[self.n:self.n + len(count)] = count
        self.begin[self.n:self.n + len(count)] = self.used + np.cumsum(count) - count
        self.used, self.n = self.used + len(flat), self.n + len(count)
        return np.array(whole, bool)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokenizer.bytes.__getitem__, ids))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of numbered segments on end, and how many each has."""
        n = self.count[numbers]
        return self.flat[np.repeat(self.begin[numbers] - np.cumsum(n) + n, n) + np.arange(n.sum())], n


class Encoder:
    """Texts as numbers of segments, with a space before each text, and both tokenizers' packed tokens of the segments."""

    def __init__(self, path_a: str, path_b: str):
        one_thread()
        self.sides = Side(ByteLevel(path_a)), Side(Pieces(path_b))
        self.clear()
        self.table = Table(self.learn, self.clear, TABLE_CHARS)

    def clear(self) -> None:
        self.whole = np.zeros(0, bool)
        for side in self.sides:
            side.clear()

    def learn(self, segments: list[str]) -> None:
        a, b = (side.learn(segments) for side in self.sides)
        self.whole = np.concatenate([self.whole, a & b])

    def alone(self, text: str) -> list[np.ndarray] | None:
        """Both sides' tokens of a text of which some segment's bytes differ, or none if the whole text's bytes differ, too."""
        every = [side.tokenizer.encode([" " + text])[0] for side in self.sides]
        if all(side.joined(ids) == (" " + text).encode() for side, ids in zip(self.sides, every)):
            return [side.packed(ids) for side, ids in zip(self.sides, every)]
        return None


@functools.lru_cache(maxsize=2)
def encoder_of(path_a: str, path_b: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    return Encoder(path_a, path_b)


def give_back() -> None:
    """A block's memory goes back to the machine; else a worker keeps what its largest block took, beside its executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


BLOCK = "block long, docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, codes: array<int>>>, times array<bigint>, a array<bigint>, b array<int>, a_ends array<bigint>, b_ends array<bigint>"


def as_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)))


class Block:
    """Documents whose segments are told apart together."""

    def __init__(self, encoder: Encoder):
        encoder.table.make_room()
        self.encoder, self.ids, self.texts, self.numbers, self.of_text, self.bytes = encoder, [], [], [], [], 0

    def add(self, part: pa.RecordBatch) -> None:
        texts = part.column(1).to_pylist()
        numbers, of_text = segment_counts(self.encoder.table, texts, " ")
        self.ids.append(part.column(0))
        self.texts += texts
        self.numbers.append(numbers)
        self.of_text.append(of_text)
        self.bytes += sum(len(t or "") for t in texts)

    def row(self, name: int) -> pa.RecordBatch:
        numbers, of_text = np.concatenate(self.numbers), np.concatenate(self.of_text)
        document = np.repeat(np.arange(len(of_text)), of_text)
        odd = np.unique(document[~self.encoder.whole[numbers]])
        plain = ~np.isin(document, odd)
        times = np.bincount(numbers[plain], minlength=len(self.encoder.whole))
        found = np.flatnonzero(times)
        place = np.zeros(len(times), np.int32)
        place[found] = np.arange(len(found))
        times = times[found].tolist()
        of_text[odd] = 0
        both = [side.of(found) for side in self.encoder.sides]
        tokens, counts = [[t] for t, _ in both], [[n] for _, n in both]
        lists = np.split(place[numbers[plain]], np.cumsum(of_text)[:-1])
        del numbers, document, plain, place
        for d in odd.tolist():
            alone = self.encoder.alone(self.texts[d])
            if alone:
                lists[d] = np.array([len(times)], np.int32)
                times.append(1)
                for k in (0, 1):
                    tokens[k].append(alone[k])
                    counts[k].append(np.array([len(alone[k])], np.int64))
        flat, sizes = map(np.concatenate, tokens), [np.concatenate(n) for n in counts]
        a, b = flat
        n_a, n_b = (pa.array([int(n[c].sum()) for c in lists], pa.int64()) for n in sizes)
        docs = pa.StructArray.from_arrays([pa.concat_arrays(self.ids), n_a, n_b, as_lists(lists)], ["doc_id", "n_a", "n_b", "codes"])
        with_code = np.repeat(np.arange(len(times)), sizes[0]) << 32 | a
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        ends = [pa.array(np.cumsum(x & (WIDTH - 1), dtype=np.int64)) for x in (a, b)]
        columns = map(one, [docs, pa.array(times, pa.int64()), pa.array(with_code), pa.array(b), *ends])
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *columns], ["block", "docs", "times", "a", "b", "a_ends", "b_ends"])


def blocks(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, block_bytes: int) -> DataFrame:
    """A row for each block: a token of a begins with its segment's number, times has how often each segment stands there, a_ends
    and b_ends have the byte that each token ends at."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, name, block = encoder_of(path_a, path_b), TaskContext.get().partitionId() << 33, None
        for batch in batches:
            for part in balanced(batch, 1, min(BATCH_BYTES, block_bytes)):
                block = block or Block(encoder)
                block.add(part)
                if block.bytes >= block_bytes:
                    yield block.row(name)
                    name, block = name + 1, None
                    give_back()
        if block:
            yield block.row(name)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, BLOCK)


@contextlib.contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Inside, a join on (segment, end) takes rows that are dealt by segment as they lie; the setting goes back after it."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bucketed(df: DataFrame, name: str) -> DataFrame:
    """stored(), but dealt by block for good: windows and joins within blocks read it as it lies. Each row is one of few."""
    spark = df.sparkSession
    table = f"tessera_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.bucketBy(SPREAD * shuffle_width(spark), "block").option("path", path).option("compression", "zstd").saveAsTable(table)
    place, files = on_disk(spark, path)
    files.deleteOnExit(place)
    return spark.table(table)


def tokens(found: DataFrame, side: str) -> DataFrame:
    """block, end, place of every token."""
    return found.select("block", F.posexplode(f"{side}_ends").alias(f"{side}_place", "end"))


def links(found: DataFrame) -> DataFrame:
    """block, end, a_place, b_place: the places where tokens of both sides end together."""
    return tokens(found, "a").join(tokens(found, "b"), ["block", "end"])


HALF = (1 << 32) - 1


def cuts(found: DataFrame) -> DataFrame:
    """block, cuts: each block's links in order, a's place and b's place in one number."""
    both = F.shiftleft(F.col("a_place").cast("long"), 32) + F.col("b_place")
    return links(found).groupBy("block").agg(F.sort_array(F.collect_list(both)).alias("cuts"))


class Met:
    """A block's tokens and its cuts, in order: segment, a's token and b's of each link."""

    def __init__(self, row: pa.RecordBatch):
        column = lambda name: row.column(name).flatten()  # noqa: E731  of one row; a missing list is an empty one
        numbers = lambda name: column(name).to_numpy(zero_copy_only=False)
        a, self.b, cut, self.times = (numbers(name) for name in ("a", "b", "cuts", "times"))
        self.docs, self.a, self.b = column("docs"), a.astype(np.int32) >> 8, self.b >> 8
        self.at_a, self.at_b = (cut >> 32).astype(np.int32), cut.astype(np.int32)
        self.code = (a[self.at_a] >> 32).astype(np.int32)
        self.pair = self.a[self.at_a] * np.int64(IDS) + self.b[self.at_b]


def each_block(batches) -> Iterator[tuple[int, Met, pa.RecordBatch]]:
    encoder_of.cache_clear()  # texts are read no more
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row.column("block")[0].as_py(), Met(row), row
            give_back()


def pairs_of_blocks(whole: DataFrame) -> DataFrame:
    """block, pair, times: each pair of ids that a block links, and how often it does in all its texts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for block, met, _ in each_block(batches):
            pair, which = np.unique(met.pair, return_inverse=True)
            times = np.zeros(len(pair), np.int64)
            np.add.at(times, which, met.times[met.code])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block, np.int64)), pa.array(pair), pa.array(times)], ["block", "pair", "times"])

    return whole.mapInArrow(run, "block long, pair long, times long")


def rated(spark: SparkSession, each: DataFrame) -> DataFrame:
    """block, rates: each block's pairs in order, with their corpus-wide counts and whether it is the highest of their b's."""
    pairs = each.groupBy("pair").agg(F.sum("times").alias("count"))
    b = F.col("pair") % IDS
    most = pairs.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    known = stored(pairs.join(most, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "id-pairs")
    sent = F.broadcast(known) if known.count() <= SENT_PAIRS else known
    return each.join(sent, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("rates"))


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of runs of values, which end before these places."""
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])[np.concatenate([[0], ends])])


def joined_texts(texts: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    """Runs of texts, which end before these places, each as one."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int64()), texts), pa.scalar(by, pa.large_string()))


def decimals(ids: np.ndarray) -> pa.Array:
    return pc.cast(pa.array(ids), pa.large_string())


def segment_texts(met: Met, last: np.ndarray) -> Iterator[pa.Array]:
    """The groups of every segment, some segments at a time: links end before `last`, and the tokens of a link are those after the one before it."""
    def side(ids: np.ndarray, at: np.ndarray, first: int, end: int) -> pa.Array:
        begin = at[first - 1] + 1 if first else 0
        return joined_texts(decimals(ids[begin:at[end - 1] + 1]), at[first:end] + 1 - begin, ",")

    done = 0
    while done < len(last):
        first = int(last[done - 1]) if done else 0
        upto = max(done + 1, int(np.searchsorted(last, first + SEGMENTS, side="right")))
        end = int(last[upto - 1])
        groups = pc.binary_join_element_wise(side(met.a, met.at_a, first, end), side(met.b, met.at_b, first, end), pa.scalar("|", pa.large_string()))
        yield joined_texts(groups, last[done:upto] - first, ";")
        done = upto


DOCUMENT = "doc_id long, n_a long, n_b long, n_links long, n_best long, count_sum long, groups string"


def documents(whole: DataFrame) -> DataFrame:
    """Each document's sums over its segments' links, and its groups as text."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for _, met, row in each_block(batches):
            rates = row.column("rates").flatten()
            pair, count, best = (pc.struct_field(rates, i).to_numpy(zero_copy_only=False) for i in range(3))
            of_link = np.searchsorted(pair, met.pair)
            last = np.searchsorted(met.code, np.arange(len(met.times), dtype=np.int32), side="right")  # a segment's links end before it
            measured = [sums(x[of_link], last) for x in (np.ones(len(pair), np.int64), best, count)]
            del of_link, met.pair, met.code
            segments = pa.concat_arrays([pa.array([], pa.large_string()), *segment_texts(met, last)])
            doc_id, n_a, n_b, codes = (pc.struct_field(met.docs, i) for i in range(4))
            flat, upto = codes.flatten(), np.cumsum(pc.list_value_length(codes).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < len(upto):  # some documents at a time, since their texts repeat the segments'
                first = upto[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(upto, first + SEGMENTS, side="right")))
                some, ends = flat.slice(first, upto[end - 1] - first), upto[at:end] - first
                of_doc = [pa.array(sums(x[some.to_numpy()], ends)) for x in measured]
                texts = joined_texts(segments.take(some), ends, ";").cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(x.slice(at, end - at) for x in (doc_id, n_a, n_b)), *of_doc, texts], ["doc_id", "n_a", "n_b", "n_links", "n_best", "count_sum", "groups"])
                at = end

    return whole.mapInArrow(run, DOCUMENT)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: each row's tokens, groups and links, and its groups as
    text: a1,a2|b1;a3|b2,b3."""
    spark = docs.sparkSession
    found = bucketed(blocks(docs, id_col, text_col, *(paths or public_vocabularies()), block_bytes), "blocks")
    with joined_in_place(spark):
        met = bucketed(cuts(found), "cuts")
    whole = found.join(met, "block", "left").select("block", "docs", "times", "a", "b", "cuts")
    each = bucketed(pairs_of_blocks(whole), "block_pairs")
    out = documents(whole.join(rated(spark, each), "block", "left"))
    # a cut ends a group and is a link of the two tokens before it
    return out.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups")
