"""op4: a row without an id takes no links from the rows it stands before."""

import pytest

from tessera.llm import vector_dedup


@pytest.mark.parametrize("nulls", [1, 3])
def test_null_id_first(spark, nulls):
    rows = [(None, [1.0, 2.0, 3.0])] * nulls + [(5, [1.0, 2.0, 3.0]), (9, [2.0, 4.0, 6.0]), (7, [-1.0, 0.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect())
    assert got == [("5", nulls + 1, 5, True), ("7", 0, 7, True), ("9", nulls + 1, 5, False)] + [("None", nulls + 1, None, None)] * nulls
