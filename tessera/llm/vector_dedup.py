"""Embedding near-dedup: int8 tile products with rigorous per-vector error bounds.

Vectors are dealt over tiles of about `tile_rows`; each pair of tiles meets once, as two blocks, in one task. There a
unit vector v is quantised to s * q with q in int8, and its error norm e = |v - s q| is kept. For any two vectors

    v.w <= s_v s_w q_v.q_w + e_v |s_w q_w| + e_w |s_v q_v| + e_v e_w

so only pairs whose right side reaches the threshold can be links; these alone are computed again in double
precision. The integer products are exact: they run as float32 products of whole numbers below 2 ** 24. A task
returns, not the pairs, but each vector's number of links and a spanning forest of them, so a dense group of any size
leaves at most one edge a vector. Components follow from the forests' edges.

Defined cases: vectors that are null, empty, zero, or have null or non-finite components link with nothing and are
their own component; vectors of different lengths never link; repeated rows are vectors of their own and link with
each other; a row with a null id has its links counted but passes on no component, so it is in no forest, and those
that it links with keep their own links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

THRESHOLD, TILE_ROWS, BLOCK = 0.9, 16384, 512
#: Room for rounding in the bounds themselves, far above float64 error and far below any distance that matters.
SLACK = 1e-6
EXACT_DIM = (1 << 24) // (127 * 127)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """unit vectors, int8 values as float32, scales, norms of the quantised vectors, error norms."""
    x = x / np.abs(x).max(axis=1, initial=0, keepdims=True)  # squares of very small or large components would leave double's range
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1, initial=0) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return unit, q.astype(np.float32), scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def pair_blocks(a: tuple, b: tuple, threshold: float, same: bool):
    """Yields (rows of a, rows of b) of links, block by block; with same, each pair once."""
    unit_a, qa, sa, na, ea = a
    unit_b, qb, sb, nb, eb = b
    dim = qa.shape[1]
    for at in range(0, len(qa), BLOCK):
        first = at if same else 0
        rows = slice(at, at + BLOCK)
        product = np.zeros((len(qa[rows]), len(qb) - first), np.float32 if dim <= EXACT_DIM else np.float64)
        for d in range(0, dim, EXACT_DIM):
            product += qa[rows, d:d + EXACT_DIM] @ qb[first:, d:d + EXACT_DIM].T
        # the loosest bound of the block, then each pair's own
        loose = ea[rows] * nb[first:].max(initial=0) + eb[first:].max(initial=0) * (na[rows] + ea[rows]) + SLACK
        i, j = np.nonzero(product >= ((threshold - loose) / sa[rows] / sb[first:].max(initial=1e-30))[:, None])
        near = product[i, j].astype(np.float64)
        i, j = i + at, j + first
        bound = near * sa[i] * sb[j] + ea[i] * nb[j] + eb[j] * na[i] + ea[i] * eb[j] + SLACK
        ok = (bound >= threshold) & ((i < j) if same else True)
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 1 << 15):
            part = slice(k, k + (1 << 15))
            link = np.einsum("ij,ij->i", unit_a[i[part]], unit_b[j[part]]) >= threshold
            if link.any():
                yield i[part][link], j[part][link]


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(n: int, i: np.ndarray, j: np.ndarray, parent: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join two trees of parent, which is updated."""
    out = []
    roots = parent
    while True:  # flatten, so that most pairs are seen to be joined without a walk
        up = roots[roots]
        if (up == roots).all():
            break
        roots[:] = up
    open_ = roots[i] != roots[j]
    for a, b in zip(i[open_].tolist(), j[open_].tolist()):
        ra, rb = find(parent, a), find(parent, b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


BLOCKS = pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("tiles", pa.int64()), ("rids", pa.binary()), ("ids", pa.binary()), ("single", pa.bool_()), ("data", pa.binary())])
FOUND = pa.schema([("rid", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def joined_tiles(tables: list[dict], dim: int, threshold: float) -> pa.Table:
    """Links of one pair of tiles: rows (rid, links) and rows (a, b)."""
    x = [np.frombuffer(t["data"], np.float32 if t["single"] else np.float64).astype(np.float64).reshape(-1, dim) for t in tables]
    rid = [np.frombuffer(t["rids"], np.int64) for t in tables]
    ids = [np.frombuffer(t["ids"], np.int64) for t in tables]
    same = len(tables) == 1
    a, b = quantised(x[0]), None
    b = a if same else quantised(x[1])
    n = len(x[0])
    total = n if same else n + len(x[1])
    all_rid, all_ids = (rid[0], ids[0]) if same else (np.concatenate(rid), np.concatenate(ids))
    named = all_ids != np.iinfo(np.int64).min
    count, parent, edges = np.zeros(total, np.int64), np.arange(total), []
    for i, j in pair_blocks(a, b, threshold, same):
        j = j if same else j + n
        count += np.bincount(i, minlength=total) + np.bincount(j, minlength=total)
        both = named[i] & named[j]  # a row without an id would join trees here and then leave, and the direct links with it
        edges += forest(total, i[both], j[both], parent)
    some = np.flatnonzero(count)
    edge = [(all_ids[p], all_ids[q]) for p, q in edges]
    k = len(edge)
    return pa.table([
        pa.array([*all_rid[some].tolist(), *[None] * k], pa.int64()), pa.array([*count[some].tolist(), *[None] * k], pa.int64()),
        pa.array([*[None] * len(some), *[int(e[0]) for e in edge]], pa.int64()), pa.array([*[None] * len(some), *[int(e[1]) for e in edge]], pa.int64()),
    ], schema=FOUND)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    v = F.col("v")
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"  # tiles keep the input's own precision
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    all_rows = stored(
        vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .withColumn("usable", v.isNotNull() & (F.size("v") > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)),
        "vectors",
    )
    rows = all_rows.where("usable").select("rid", "id", "v", F.size("v").alias("dim"))
    tiles_of = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).alias("tiles"))
    dealt = rows.join(tiles_of, "dim").withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles")))
    none = np.iinfo(np.int64).min

    def blocked(table):
        dim = table["dim"][0].as_py()
        data = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64)
        row = [dim, table["tile"][0].as_py(), table["tiles"][0].as_py(), table["rid"].to_numpy().tobytes(),
               np.array([none if i is None else i for i in table["id"].to_pylist()], np.int64).tobytes(), single, data.tobytes()]
        return pa.table([[x] for x in row], schema=BLOCKS)

    blocks = dealt.groupBy("dim", "tile").applyInArrow(blocked, "dim int, tile long, tiles long, rids binary, ids binary, single boolean, data binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    met = blocks.withColumn("other", other).select("dim", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "rids", "ids", "single", "data")

    def linked(key, table):
        parts = sorted(table.to_pylist(), key=lambda r: r["tile"])
        if len(parts) == 1 and key[1].as_py() != key[2].as_py():
            return FOUND.empty_table()  # the other tile has no rows
        return joined_tiles(parts, key[0].as_py(), threshold)

    found = stored(met.groupBy("dim", "lo", "hi").applyInArrow(linked, "rid long, links long, a long, b long"), "vector-links")
    links = found.where("rid is not null").groupBy("rid").agg(F.sum("links").alias("n_links"))
    comp = components(found.where("a is not null").select("a", "b"), "vector-components")
    out = all_rows.select("rid", "id").join(links, "rid", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
