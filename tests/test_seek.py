"""Pages that are sought by key, joined, are the whole queue."""

import pytest

from tessera.operators import analytics as A


@pytest.mark.parametrize("down", [True, False])
def test_pages_joined(spark, down):
    rows = [(i, None if i % 11 == 0 else float(i * 7 % 13), None if i % 17 == 0 else i % 5) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, price double, part int").repartition(3)
    order = [("price", down), ("part", not down), ("id", False)]
    got, last = [], None
    while page := A.seek(df, order, last, 7).collect():
        got += page
        last = page[-1].asDict()
    rank = lambda v, d: (v is None, 0 if v is None else (-v if d else v))
    assert [r.id for r in got] == [r[0] for r in sorted(rows, key=lambda r: (rank(r[1], down), rank(r[2], not down), r[0]))]


def test_the_range_reaches_the_scan(spark, tiny):
    page = A.seek(spark.read.parquet(f"{tiny}/orders.parquet"), [("o_totalprice", True), ("o_orderkey", False)], {"o_totalprice": 1000.0, "o_orderkey": 3}, 5)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(o_totalprice,1000.0)" in plan
