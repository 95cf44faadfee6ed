"""Texts cut where no token of the public tokenizers reaches across, and tables of what is known of each distinct segment.

A boundary lies before one space that stands between two printable characters, ASCII or Latin, that are no space.
Byte-level BPE parts words there before it merges anything, a special string holds no space, and a vocabulary of pieces
that have their space mark in front, if at all, has no merge across it. So a text's tokens are its segments' tokens in
order, whatever stands around them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BOUNDARY = re.compile(r"(?<=[!-~À-ɏ])(?= [!-~À-ɏ])")
#: Characters of a text that are in Python objects at once, and bytes of the texts of one batch.
BLOCK, BATCH_BYTES = 1 << 20, 1 << 21
#: A table starts anew beyond so many characters of segments.
TABLE_CHARS = 1 << 26


def one_thread() -> None:
    """A task has one core: the tokenizers' own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def pieces(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in pieces of about size characters, cut at boundaries only; a stretch without any stays whole."""
    at = 0
    while len(text) - at > size:
        found = BOUNDARY.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def balanced(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `most` bytes each; a longer text is a slice of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


class Table:
    """Numbers distinct segments in order of first sight; learn(new segments) is told of each once, clear() when all start anew."""

    def __init__(self, learn: Callable[[list[str]], None], clear: Callable[[], None], most: int = TABLE_CHARS):
        self.learn, self.forget, self.most = learn, clear, most
        self.places: dict[str, int] = {}
        self.chars = 0

    def make_room(self) -> None:
        """Between two batches: numbers given before it hold no more if the table was full."""
        if self.chars > self.most:
            self.places, self.chars = {}, 0
            self.forget()

    def numbers(self, segments: list[str]) -> np.ndarray:
        known = self.places
        new = [s for s in dict.fromkeys(segments) if s not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.chars += sum(map(len, new)) + 64 * len(new)
            self.learn(new)
        return np.fromiter(map(known.__getitem__, segments), np.int64, len(segments))


def segment_counts(table: Table, texts: list[str | None], prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all segments on end, how many each text has); prefix is put before each text that isn't empty."""
    numbers, counts, held, chars = [], np.zeros(len(texts), np.int64), [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        for piece in pieces(prefix + text):
            cut = BOUNDARY.split(piece)
            counts[i] += len(cut)
            held += cut
            chars += len(piece)
            if chars > BLOCK:
                numbers.append(table.numbers(held))
                held, chars = [], 0
    numbers.append(table.numbers(held))
    return np.concatenate(numbers), counts
