"""Cost-balanced packing of tokenised documents into fixed-size sequences.

Each task tokenises its documents and packs them in groups of at most `group_sequences` full sequences, so nothing
is shuffled and a group's memory is bounded. In a group, pieces go in descending length to the sequence of lowest
cost, `linear * tokens + quadratic * sum of squared piece lengths`, that has room. A piece that fits nowhere whole
is cut over the emptiest sequences. A group's capacity is exactly its tokens: sequences of `size` and, for what is
over, sequences of descending powers of two, which need no padding.

A word is tokenised once and kept in a bounded table: the tokenizer lower-cases, drops white space and never merges
over it, so a text's ids are its words' ids in order.

Defined cases: null text counts as empty, and an empty text is its end token alone; repeated rows are packed each;
null ids are kept; an empty table gives an empty result; other columns are ignored. A rerun of a task over the same
input split gives the same rows.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import slices

SIZE, END, GROUP_SEQUENCES = 4096, 2, 512
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
CACHED_WORDS, FRESH_WORDS = 1_000_000, 100_000


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """ids of texts by a table of words; words are told apart by 64-bit hashes of their bytes, ASCII case folded.

    A full stop or comma after an ASCII letter or digit is a word of its own, as the tokenizer parts it there too.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(1 + max(vocabulary.values()), bool)  # ids that end a word
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted; the words' rows
        self.fresh: dict[int, int] = {}  # rows of words that are not in there yet
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.count, self.n = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 0

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of words, -1 for those that are not known."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        out = np.where(self.hashes[at] == hashes, self.places[at], -1) if len(self.hashes) else np.full(len(hashes), -1)
        open_ = np.flatnonzero(out < 0)
        out[open_] = [self.fresh.get(h, -1) for h in hashes[open_].tolist()]
        return out

    def settle(self) -> None:
        hashes = np.concatenate([self.hashes, np.fromiter(self.fresh.keys(), np.uint64, len(self.fresh))])
        places = np.concatenate([self.places, np.fromiter(self.fresh.values(), np.int32, len(self.fresh))])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places, self.fresh = hashes[order], places[order], {}

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids on end and their numbers. Plain words go through the tokenizer as one text."""
        plain = np.array([w.isalpha() for w in words], bool)
        one = " ".join(w for w, p in zip(words, plain) if p)
        joined = np.array(self.tokenizer.encode(one, add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.last[joined]) + 1
        if len(ends) != plain.sum():  # a plain word was cut after all
            plain[:] = False
            joined, ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        count = np.zeros(len(words), np.int64)
        count[plain] = np.diff(ends, prepend=0)
        others = [e.ids for e in self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False)]
        count[~plain] = list(map(len, others))
        flat = np.empty(count.sum(), np.uint32)
        of_plain = np.repeat(plain, count)
        flat[of_plain] = joined
        flat[~of_plain] = list(itertools.chain.from_iterable(others))
        return flat, count

    def learn(self, hashes: list[int], words: list[str]) -> None:
        flat, count = self.encoded(words)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(words) > len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.flat[self.used:self.used + len(flat)] = flat
        self.begin[self.n:self.n + len(words)] = self.used + np.cumsum(count) - count
        self.count[self.n:self.n + len(words)] = count
        self.fresh.update(zip(hashes, range(self.n, self.n + len(words))))
        self.used, self.n = self.used + len(flat), self.n + len(words)
        if len(self.fresh) > FRESH_WORDS:
            self.settle()

    def encode_all(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for at, n_texts, words in wordhash.chunks(column, " \n", fold_case=True, marks_apart=True):
            if b"<|" in words.data.tobytes():  # special pieces are told by case
                for e in self.tokenizer.encode_batch_fast([t or "" for t in column.slice(at, n_texts).to_pylist()], add_special_tokens=False):
                    yield np.array(e.ids, np.uint32)
                continue
            code, distinct = pd.factorize(words.hash)
            rows = self.rows_of(distinct)
            if (rows < 0).any():
                if self.n > self.cached:
                    self.clear()
                    rows[:] = -1
                new = np.flatnonzero(rows < 0)
                place = np.empty(len(distinct), np.int64)
                place[code] = np.arange(len(code))
                rows[new] = self.n + np.arange(len(new))
                self.learn(distinct[new].tolist(), [words.text(i) for i in place[new].tolist()])
            row = rows[code]
            n = self.count[row].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(n)])
            ids = self.flat[np.repeat(self.begin[row] - upto[:-1], n) + np.arange(upto[-1])]
            edges = upto[words.first]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                yield ids[a:b]


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each Python worker, kept from task to task."""
    return WordTokenizer(path)


def balanced(lengths: np.ndarray, size: int = SIZE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths, without padding."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []  # (length, document, start)
    sequence = 0
    for d, n in enumerate(lengths.tolist()):
        start = 0
        while n - start >= size:
            pieces.append((d, start, size, sequence, 0))
            sequence, start = sequence + 1, start + size
        if start < n:
            rest.append((n - start, d, start))
    total = sum(n for n, _, _ in rest)
    capacity = [size] * (total // size) + [1 << b for b in reversed(range(size.bit_length())) if total % size >> b & 1]
    room, cost = np.array(capacity, np.int64), np.zeros(len(capacity))
    filled = np.zeros(len(capacity), np.int64)

    def place(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, sequence + s, int(filled[s])))
        room[s] -= n
        filled[s] += n
        cost[s] += linear * n + quadratic * n * n

    for n, d, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        fits = room >= n
        if fits.any():
            place(d, start, n, int(np.where(fits, cost, np.inf).argmin()))
            continue
        while n:
            s = int(room.argmax())
            k = min(n, int(room[s]))
            place(d, start, k, s)
            n, start = n - k, start + k
    return pieces


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SIZE, end: int = END,
         group_sequences: int = GROUP_SEQUENCES, linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, as binary, if asked for)."""
    path = tokenizer or public_vocabulary()
    schema = SCHEMA.append(pa.field("ids", pa.binary())) if with_ids else SCHEMA

    def run(batches) -> Iterator[pa.RecordBatch]:
        words = tokenizer_of(path)
        base = TaskContext.get().partitionId() << 36
        last = end.to_bytes(4, "little")
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, tokens
            lengths = np.array([len(b) // 4 for _, b in held], np.int64)
            out = balanced(lengths, size, linear, quadratic)
            rows = []
            for d, start, n, s, offset in out:
                ids = held[d][1][4 * start:4 * (start + n)]
                rows.append((held[d][0], start, n, zlib.crc32(ids), int(lengths[d]), base + s, offset) + ((ids,) if with_ids else ()))
            base += 1 + max((p[3] for p in out), default=-1)
            held.clear()
            tokens = 0
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + 10_000]), schema)], schema=schema)

        for b in slices(batches):
            for d, found in zip(b.column(0).to_pylist(), words.encode_all(b.column(1))):
                held.append((d, found.tobytes() + last))
                tokens += len(found) + 1
                if tokens >= group_sequences * size:
                    yield from flush()
        if held:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DDL + (", ids binary" if with_ids else ""))
