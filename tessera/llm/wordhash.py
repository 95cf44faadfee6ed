"""Words of many texts at once, as 64-bit hashes, straight from Arrow's buffers with numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

P = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK = 2 << 20


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P ** i and its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(P), -1, 1 << 64))
    with np.errstate(over="ignore"):
        a = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, P)]), dtype=np.uint64)
        b = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
    return a, b


def byte_table(fold_case: bool) -> np.ndarray:
    out = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if fold_case:
        out[65:91] = out[97:123]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class Words:
    """data: the bytes; start, end: each word's bytes; hash: its hash; first: per text, the place of its first word (one more at the end)."""

    __slots__ = ("data", "start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, edges: np.ndarray, separators: np.ndarray, table: np.ndarray, marks_apart: bool = False):
        n = len(data)
        inside = np.empty(n + 1, bool)
        inside[:n] = ~separators[data]
        inside[n] = False
        opens = inside[:n].copy()
        opens[1:] &= ~inside[:n - 1] if n else inside[:0]
        begins = edges[:-1][edges[:-1] < n]
        opens[begins] = inside[begins]
        closes = inside[:n] & ~inside[1:]
        ends = edges[1:][edges[1:] > 0] - 1
        closes[ends] = inside[ends]
        if marks_apart and n > 1:  # a full stop or comma at a word's end, after an ASCII letter or digit
            i = np.flatnonzero(closes & ~opens & ((data == 46) | (data == 44)))
            i = i[ALNUM[data[i - 1]]]
            opens[i], closes[i - 1] = True, True
        self.data, self.start, self.end = data, np.flatnonzero(opens), np.flatnonzero(closes) + 1
        a, b = powers(max(CHUNK, 1 << max(1, n - 1).bit_length()))
        with np.errstate(over="ignore"):
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[data] * a[:n], out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * b[self.start]
            self.hash = mixed(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.first = np.searchsorted(self.start, edges)

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode()


def chunks(column: pa.Array, separators: str, fold_case: bool, marks_apart: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, rows, words) of runs of texts of about CHUNK bytes; null texts are empty."""
    seps = np.zeros(256, bool)
    seps[list(separators.encode())] = True
    table = byte_table(fold_case)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        to = min(to, len(column))
        edges = offsets[at:to + 1]
        yield at, to - at, Words(data[edges[0]:edges[-1]], edges - edges[0], seps, table, marks_apart)
        at = to
