"""Stages stop on unchanged input; a change runs what it touches; a revert is a change again."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import screening as S
from tessera.sources import ledger as L
from tessera.sources import watchlist

ENTRY = "<sdnEntry><uid>{uid}</uid><firstName>{first}</firstName><lastName>{last}</lastName><sdnType>Individual</sdnType></sdnEntry>"


def write(folder, name, *people):
    body = "".join(ENTRY.format(uid=u, first=f, last=n) for u, f, n in people)
    at = folder / name
    at.write_text(f"<sdnList>{body}</sdnList>")
    os.utime(at, None)


def stages():
    names = lambda i: text.with_name(i["names"], F.col("name"))
    return [
        L.Stage("entries", (), lambda spark, path: watchlist.read_entries(spark, path).select("uid", "primary_name", "akas", "sdn_type")),
        L.Stage("names", ("entries",), lambda i: watchlist_names(i["entries"])),
        L.Stage("normalized", ("names",), lambda i: names(i).select("uid", "normalized", "tokens")),
        L.Stage("stats", ("normalized",), lambda i: S.token_stats(i["normalized"]).select("token", "document_frequency", F.round("idf", 6).alias("idf"))),
        L.Stage("checks", ("entries",), lambda i: i["entries"].agg(F.count(F.lit(1)).alias("n"))),
        L.Stage("report", ("stats", "checks"), lambda i: i["stats"].agg(F.count(F.lit(1)).alias("tokens")).crossJoin(i["checks"])),
    ]


def watchlist_names(entries):
    return entries.select("uid", F.col("primary_name").alias("name"))


@pytest.fixture
def pipe(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.xml", (1, "Ivan", "Petrov"), (2, "Maria", "Rossi"))
    return L.Pipeline(spark, str(tmp_path / "out"), stages()), tmp_path / "in"


def test_unchanged_changed_reverted(spark, pipe):
    p, folder = pipe
    every = lambda s: {x.name: s for x in stages()}
    assert p.run(str(folder)) == every("ran")
    assert p.run(str(folder)) == every("skipped")
    assert {r.state for r in L.fetched(spark, str(folder), p.ledger()).collect()} == {"not_modified"}
    os.utime(folder / "a.xml", (1, 1))  # touched, same content: read, and nothing runs
    assert {r.state for r in L.fetched(spark, str(folder), p.ledger()).collect()} == {"unchanged"}
    assert p.run(str(folder)) == every("skipped")
    write(folder, "a.xml", (1, "ivan", "PETROV"), (2, "Maria", "Rossi"))  # another spelling of the same normalized name
    assert p.run(str(folder)) == {"entries": "ran", "names": "ran", "normalized": "same", "stats": "skipped", "checks": "same", "report": "skipped"}
    write(folder, "b.xml", (3, "Boris", "Novak"))
    assert p.run(str(folder)) == every("ran")
    assert p.output("report").first().asDict() == {"tokens": 6, "n": 3}
    (folder / "b.xml").unlink()
    write(folder, "a.xml", (1, "Ivan", "Petrov"), (2, "Maria", "Rossi"))
    assert p.run(str(folder)) == every("ran")
    assert p.output("report").first().asDict() == {"tokens": 4, "n": 2} and p.run(str(folder)) == every("skipped")


def test_follow_runs_on_arrival(spark, pipe, tmp_path):
    p, folder = pipe
    p.follow(str(folder), str(tmp_path / "cp")).awaitTermination(60)
    assert p.output("checks").first().n == 2
    runs = p.ledger().count()
    p.follow(str(folder), str(tmp_path / "cp")).awaitTermination(60)
    assert p.ledger().count() == runs
    write(folder, "b.xml", (3, "Boris", "Novak"))
    p.follow(str(folder), str(tmp_path / "cp")).awaitTermination(60)
    assert p.output("checks").first().n == 3


def test_stages_in_order(spark):
    with pytest.raises(ValueError):
        L.Pipeline(spark, "/tmp/none", [L.Stage("b", ("a",), None), L.Stage("a", (), None)])


def test_digests(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, "x", None), (2, "x", None)], "a long, b string, c array<string>")
    assert L.table_digest(df) == L.table_digest(df.select("c", "a", "b").repartition(3)) != L.table_digest(df.distinct())
    assert L.table_digest(df.limit(0)) == "0:0"


def test_two_writers_at_once(spark, tmp_path):
    root = str(tmp_path / "t")
    todo = [threading.Thread(target=watchlist.publish, args=(spark.range(i + 1).toDF("id"), root, f"v{i}")) for i in range(4)]
    for t in todo:
        t.start()
    for t in todo:
        t.join()
    pointers = spark.read.schema("n long, path string").json(f"{root}/{watchlist.POINTERS}").collect()
    assert len({r.n for r in pointers}) == len(pointers) == 4 and {spark.read.parquet(r.path).count() for r in pointers} == {1, 2, 3, 4}
    assert not watchlist.pointed(spark, root, 1, "late")
