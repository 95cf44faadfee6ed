"""Chains over ranges: one tenant's log in many tasks, the hash handed from range to range, and going on from a checkpoint."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import history as H


@pytest.fixture(scope="module")
def log(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2990, 1).when(F.col("id") < 2995, 2).alias("tenant"), "id", F.concat(F.lit("p"), "id").alias("body"))
    chained = H.append_chained(spark, rows, "tenant", "id", "body").cache()
    yield chained
    chained.unpersist()


def faults(df, **more):
    return {r.tenant: (r.rows, r.first_broken) for r in H.chain_faults(df, "tenant", "id", F.col("body"), **more).collect()}


def at(df, i, column, value):
    return df.withColumn(column, F.when(F.col("id") == i, value).otherwise(F.col(column)))


@pytest.mark.parametrize("ranges", [1, 7])
def test_one_large_tenant(log, ranges):
    links = H.chain_links(log, "tenant", "id", F.col("body"), ranges)
    assert links.where("tenant = 1").select("range").distinct().count() >= min(ranges, 6)
    assert faults(log, ranges=ranges) == {1: (2990, None), 2: (5, None), None: (5, None)}
    firsts = [r.first for r in links.where("tenant = 1").groupBy("range").agg(F.min("id").alias("first")).collect()]
    for i in {0, 1500, 2989, *sorted(firsts)[1:3]}:  # also a range's first row, whose link is the one before's last
        bad = {1: (2990, i), 2: (5, None), None: (5, None)}
        assert faults(at(log, i, "body", F.lit("x")), ranges=ranges) == bad
        if ranges == 7:
            assert faults(at(log, i, "prev_hash", F.lit("0" * 63 + "1")), ranges=ranges) == bad
    assert faults(log.where("id <> 1500"), ranges=ranges)[1] == (2989, 1501) and faults(at(log, 2992, "hash", F.lit(None)), ranges=ranges)[2] == (5, 2992)


def test_from_a_checkpoint(log):
    heads = H.chain_heads(log.where("id < 2000 or id = 2990"), "tenant", "id")
    assert faults(log, since=heads, ranges=5) == {1: (990, None), 2: (4, None), None: (5, None)}
    assert faults(at(log, 10, "body", F.lit("x")), since=heads, ranges=5)[1] == (990, None)  # verified before
    assert faults(at(log, 2000, "prev_hash", F.lit("x")), since=heads, ranges=5)[1] == (990, 2000)
    assert faults(at(log, 1999, "hash", F.lit("x")), since=heads, ranges=5)[1] == (990, None) and faults(log.where("id <> 2000"), since=heads)[1] == (989, 2001)
    assert faults(log.limit(0)) == {}
