"""Token counts: batches balanced by bytes are encoded in Arrow functions that return lengths only.

A batch of Arrow rows is cut into slices of about BATCH_BYTES of text. Texts are split at boundaries that no token
reaches across (segments.py), so a long text is never encoded at once, and a segment that a worker knows is not encoded
again; the table of known ones starts anew beyond a number of characters. A text's count is the sum of its segments'.
Nothing is shuffled.

Defined cases: null text counts as empty, and an empty text has no tokens; the strings of special tokens in a text are
handled as the library does by default; a stretch of any length without a boundary is encoded whole; repeated rows,
null ids and ties give a row each; an empty table gives an empty result; other columns are ignored, or passed on by name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import BATCH_BYTES, Table, balanced, one_thread, segment_counts

LIMIT = 1024


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counter:
    """Token counts of texts by the tokenizer of a file, without begin, end or added special tokens, truncation or padding."""

    def __init__(self, path: str):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.clear()
        self.table = Table(self.learn, self.clear)

    def clear(self) -> None:
        self.n, self.used = np.zeros(1 << 12, np.int64), 0

    def learn(self, segments: list[str]) -> None:
        while self.used + len(segments) > len(self.n):
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
        self.n[self.used:self.used + len(segments)] = [len(e) for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        self.used += len(segments)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        self.table.make_room()
        numbers, of_text = segment_counts(self.table, texts)
        upto = np.concatenate([[0], np.cumsum(self.n[numbers])])
        edges = np.concatenate([[0], np.cumsum(of_text)])
        return upto[edges[1:]] - upto[edges[:-1]]


@functools.lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """One for each Python worker, kept from task to task."""
    return Counter(path)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row."""
    path = tokenizer or public_vocabulary()

    def run(batches) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for b in balanced(batch, 1, batch_bytes):
                n = counter.counts(b.column(1).to_pylist())
                size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], schema=SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
