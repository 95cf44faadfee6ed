"""Embedding whitening: Welford's rank-one updates in partition iterators, merged by the parallel formula, then symmetric QR.

A vector's entries become whole numbers x = floor(SCALE * c) + SHIFT. A partition's state is the number of its rows, the
exact sums of x, and the sum of the rank-one terms (k - 1) / k * d d' of its rows, d being row k's distance from the mean
of the k - 1 before it; a batch's means come from its exact running sums, and its terms are added as one product. States
are merged in streams, in two levels, so a task holds two states whatever the number of partitions; the last one, of as
many numbers as a covariance has, is all that the driver gets. Its eigenvectors are found there: Householder reflections
to a tridiagonal matrix, then QR steps with Wilkinson's shift. A second pass takes the whitened values' own covariance by
the same states.

Defined cases: rows whose vector is null, or holds null or non-finite entries, are dropped; vectors of each length are
whitened among themselves, and an empty one has no component; repeated rows and null ids count and are returned each; a
component along which nothing varies, to rounding, gives whitened 0 and explained 0; an empty table gives an empty
result; other columns are ignored. Entries must stay below 2 ** 52 / SCALE, else the task fails; the deviation is exact
up to 38 digits. A state has d * d numbers for vectors of length d.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: An eigenvalue under so many times the largest one is rounding.
NOTHING = 1e-13


class State:
    """Count, sums and summed products of distances from the mean of some rows. Rows come as whole numbers times 1 / unit."""

    def __init__(self, n: int, sums: np.ndarray, spread: np.ndarray):
        self.n, self.sums, self.spread = n, sums, spread

    @classmethod
    def empty(cls, d: int, kind=np.int64) -> State:
        return cls(0, np.zeros(d, kind), np.zeros((d, d)))

    def update(self, x: np.ndarray) -> None:
        """Welford's rank-one update for each row, summed as one product; whole numbers keep running sums exact."""
        if not len(x):
            return
        upto = np.cumsum(x, axis=0)
        before = np.arange(self.n, self.n + len(x))
        sums = self.sums + np.concatenate([np.zeros((1, x.shape[1]), x.dtype), upto[:-1]])
        d = x - sums / np.maximum(before, 1)[:, None]
        self.spread += (d * (before / (before + 1))[:, None]).T @ d
        self.n, self.sums = self.n + len(x), self.sums + upto[-1]

    def merge(self, other: State) -> None:
        """The parallel formula."""
        if self.n and other.n:
            apart = other.sums / other.n - self.sums / self.n
            self.spread += np.outer(apart, apart) * (self.n * other.n / (self.n + other.n))
        self.spread += other.spread
        self.n, self.sums = self.n + other.n, self.sums + other.sums

    def covariance(self) -> np.ndarray:
        return (self.spread + self.spread.T) / (2 * self.n)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, one beside it, q) with a = q t q', by Householder reflections."""
    a, n = a.astype(np.float64).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1:, :] -= 2 * np.outer(v, v @ a[k + 1:, :])
        a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ v, v)
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns: implicit QR steps with Wilkinson's shift on the tridiagonal form."""
    size = np.abs(a).max(initial=0) or 1.0  # squares of very small or large entries would leave double's range
    d, e, q = tridiagonal(a / size)
    vectors = q.T.copy()  # in rows, which rotations mix
    last = len(d) - 1
    while last > 0:
        small = np.abs(e[:last]) <= np.finfo(float).eps * (np.abs(d[:last]) + np.abs(d[1:last + 1]))
        e[:last][small] = 0
        if e[last - 1] == 0:
            last -= 1
            continue
        zeros = np.flatnonzero(e[:last] == 0)
        first = zeros[-1] + 1 if len(zeros) else 0
        half = (d[last - 1] - d[last]) / 2
        shift = d[last] - e[last - 1] ** 2 / (half + np.copysign(np.hypot(half, e[last - 1]), half))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            p, w, t = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * t + s * s * w, s * s * p - 2 * c * s * t + c * c * w
            e[k] = c * s * (w - p) + (c * c - s * s) * t
            if k + 1 < last:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper, lower = vectors[k].copy(), vectors[k + 1]
            vectors[k], vectors[k + 1] = c * upper + s * lower, c * lower - s * upper
    order = np.argsort(-d, kind="stable")
    return d[order] * size, vectors[order].T


class Model:
    """Exact count and sums of the fit list, components in columns, their roots, and what share of the variance each explains."""

    def __init__(self, state: State, components: int):
        values, vectors = symmetric_qr(state.covariance())
        kept = min(components, len(values))
        some = values[:kept] > max(values[0], 0) * NOTHING
        trace = float(np.trace(state.covariance()))
        self.n, self.sums, self.vectors = state.n, state.sums, vectors[:, :kept]
        self.scales = np.where(some, 1 / np.sqrt(np.where(some, values[:kept], 1)), 0.0)
        self.explained = np.where(some, values[:kept] / trace if trace else 0.0, 0.0)

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        """apart: n * x - sums, whole numbers."""
        return apart / self.n @ self.vectors * self.scales


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    scaled = np.floor(flat.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 1 << 52:
        raise OverflowError("an entry is too large to become a whole number")
    return scaled.astype(np.int64) + SHIFT


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their x-vectors) for each length of the vectors but 0."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = whole_numbers(column.flatten().to_numpy(zero_copy_only=False))
    begin = np.cumsum(n) - n
    for d in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero(n == d)
        yield rows, flat[begin[rows][:, None] + np.arange(d)]


STATE = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("spread", pa.list_(pa.float64()))])
STATE_DDL = "d int, n long, sums array<long>, spread array<double>"


def emitted(states: dict[int, State]) -> Iterator[pa.RecordBatch]:
    """States as rows, sums of whitened values as their bits."""
    for d, s in states.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([s.n]), pa.array([s.sums.view(np.int64)]), pa.array([s.spread.ravel()])], schema=STATE)


def state_of(row, kind) -> State:
    d = row["d"]
    return State(row["n"], np.array(row["sums"], np.int64).view(kind), np.array(row["spread"]).reshape(-1, len(row["sums"])) if d else np.zeros((0, 0)))


def merged(states: DataFrame, kind=np.int64) -> dict[int, State]:
    """States of partitions merged to one for each length of vectors: in streams over the session's width, then in one."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, State] = {}
        for b in batches:
            for i in range(b.num_rows):
                new = state_of({f: b.column(f)[i].as_py() for f in b.schema.names}, kind)
                d = b.column("d")[i].as_py()
                if d in held:
                    held[d].merge(new)
                else:
                    held[d] = new
        yield from emitted(held)

    spark = states.sparkSession
    some = states.repartition(shuffle_width(spark)).mapInArrow(run, STATE_DDL)
    last = some.coalesce(1).mapInArrow(run, STATE_DDL)
    return {r.d: state_of(r, kind) for r in last.collect()}


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of the column `vector`, whose rows are sound ones."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        states: dict[int, State] = {}
        for b in batches:
            for _, x in by_length(b.column(0)):
                states.setdefault(x.shape[1], State.empty(x.shape[1])).update(x)
        yield from emitted(states)

    return {d: Model(s, components) for d, s in merged(vectors.select("vector").mapInArrow(run, STATE_DDL)).items()}


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """The largest absolute entry of the whitened values' covariance minus the identity, for each length."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        states: dict[int, State] = {}
        for b in batches:
            for _, x in by_length(b.column(0)):
                m = models[x.shape[1]]
                states.setdefault(x.shape[1], State.empty(len(m.scales), np.float64)).update(m.whitened(m.n * x - m.sums))
        yield from emitted(states)

    found = merged(vectors.select("vector").mapInArrow(run, STATE_DDL), np.float64)
    return {d: float(np.abs(s.covariance() - np.eye(len(s.spread))).max()) for d, s in found.items()}


WHITENED = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def squares(apart: np.ndarray) -> pa.Array:
    """Each row's exact sum of squares."""
    if (apart.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 1 << 62:
        return pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38, 0))
    return pa.array([sum(int(v) ** 2 for v in row) for row in apart.tolist()], pa.decimal128(38, 0))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each sound vector and component."""
    sound = F.forall(vector_col, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN is above infinity
    vectors = df.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    models = fit(vectors, components)
    errors = identity_errors(vectors, models)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in by_length(b.column(1)):
                m = models[x.shape[1]]
                apart = m.n * x - m.sums
                y, k = m.whitened(apart), len(m.scales)
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(rows)).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), m.n)),
                    squares(apart).take(pa.array(each)), pa.array(y.ravel()), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(len(each), errors[x.shape[1]]))], schema=WHITENED)

    return vectors.mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
