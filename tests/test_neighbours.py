"""Exact nearest neighbours against all pairs, and what the bounds leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours
from tessera.operators import screening as S

SHAPE = "name_id long, embedding array<float>, is_active boolean"


def clustered(rng, n, clusters, dim=16, width=0.05):
    centres = rng.normal(size=(clusters, dim))
    return (centres[rng.integers(0, clusters, n)] + width * rng.normal(size=(n, dim))).astype(np.float32)


def plain(asked, held, limit, most):
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = 1 - unit(asked.astype(float)) @ unit(held.astype(float)).T
    return [[j for j in sorted(range(len(held)), key=lambda j: (round(d[i, j], 9), j))[:limit] if d[i, j] < most] for i in range(len(asked))]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    held = clustered(rng, 6000, 40)
    held[100:400] = held[100]  # equal vectors
    held[5] = 0
    asked = np.concatenate([held[:40] + np.float32(0.01), rng.normal(size=(10, 16)).astype(np.float32), np.zeros((1, 16), np.float32)])
    corpus = spark.createDataFrame([(i, v.tolist(), True) for i, v in enumerate(held)] + [(90_000, None, True), (90_001, [], True), (90_002, held[7].tolist(), False)], SHAPE)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(1000, None), (1001, [])], "query_id long, embedding array<float>")
    return asked, held, queries, corpus


@pytest.mark.parametrize("limit, most", [(50, 0.35), (3, 3.0)])
def test_nearest_are_those_of_all_pairs(world, limit, most, monkeypatch):
    asked, held, queries, corpus = world
    monkeypatch.setattr(neighbours, "CORPUS_BLOCK", 100)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    got = {}
    for r in S.by_vectors(queries, corpus, limit, most).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((round(r.distance, 6), r.name_id))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = 1 - unit(asked.astype(float)) @ unit(held.astype(float)).T
    for i, ids in enumerate(plain(asked, held, limit, most)):
        assert [x for x, _ in got.get(i, [])] == [round(d[i, j], 6) for j in ids]
        assert len({j for _, j in got.get(i, [])}) == len(ids)
    assert set(got) <= set(range(len(asked)))


def test_few_cells_are_met(world):
    asked, held, queries, corpus = world
    cells = neighbours.Cells(corpus.where("is_active"), cell_rows=100)
    _, first, rest = neighbours.candidates(queries.where(F.col("query_id") < 40), cells, 20, 0.35)
    assert cells.k > 40 and cells.size.sum() == len(held)
    assert first.count() + rest.count() < 40 * cells.k / 3


def test_nothing_to_find(spark, world):
    _, _, queries, corpus = world
    assert S.by_vectors(queries, corpus.limit(0)).count() == 0 and S.by_vectors(queries.limit(0), corpus).count() == 0
    assert S.by_vectors(queries, corpus.where("name_id = 90000")).count() == 0


@pytest.mark.parametrize("limit, most", [(50, 0.35), (3, 3.0)])
def test_blocks_find_the_nearest_of_all_pairs(world, limit, most, monkeypatch):
    """Vectors without clusters meet in blocks; equal ones are told apart by id, where rounding by place did it before."""
    from tessera.operators import blocks

    asked, held, queries, corpus = world
    for module, name, rows in ((blocks, "CORPUS_BLOCK", 2500), (blocks, "QUERY_BLOCK", 20), (neighbours, "TILE_ROWS", 700), (neighbours, "TILE_QUERIES", 6), (neighbours, "HELD_PAIRS", 300)):
        monkeypatch.setattr(module, name, rows)
    got = {}
    for r in S.by_vectors(queries, corpus, limit, most, clustered=False).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.name_id))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    d = 1 - unit(asked.astype(float)) @ unit(held.astype(float)).T
    for i, ids in enumerate(plain(asked, held, limit, most)):
        assert [j for _, j in got.get(i, [])] == ids
        assert np.allclose([x for x, _ in got.get(i, [])], d[i, ids], rtol=0, atol=1e-12)
    assert set(got) <= set(range(len(asked)))


def test_blocks_with_nothing_to_find(world):
    _, _, queries, corpus = world
    assert S.by_vectors(queries, corpus.limit(0), clustered=False).count() == 0 and S.by_vectors(queries.limit(0), corpus, clustered=False).count() == 0


def test_unclustered_names_are_not_dealt_into_cells(world, monkeypatch):
    """Every query met nearly every cell: a row for each, from one task."""
    _, _, queries, corpus = world
    monkeypatch.setattr(neighbours, "Cells", None)
    S.by_vectors(queries, corpus, clustered=False)
