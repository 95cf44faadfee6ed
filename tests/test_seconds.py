"""Seconds are those of the twins: to the nearest, not the floor of each moment."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import history as H

T = dt.datetime(2024, 1, 1)
at = lambda s: T + dt.timedelta(seconds=s)


def test_freshness_to_the_nearest_second(spark):
    rows = spark.createDataFrame([(at(0.8),), (at(0.1),)], "ts timestamp").withColumn("as_of", F.lit(at(10)))
    assert A.freshness(rows, "ts", F.max("as_of")).collect()[0].seconds == 9


def test_gaps_to_the_nearest_second(spark):
    rows = [("one", 0, at(0.9)), ("one", 1, at(61.2)), ("two", 0, at(0.2)), ("two", 1, at(60.7))]
    calls = spark.createDataFrame(rows, "provider string, id int, ts timestamp")
    got = H.breaker_openings(calls, "provider", ["ts", "id"], "ts", F.lit(True)).groupBy("provider").count().collect()
    assert {r.provider: r["count"] for r in got} == {"one": 1, "two": 2}
