"""Evaluation sets, child tables, append-only guards and countries."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import papers
from tessera.operators import changes as C
from tessera.operators import screening as S
from tessera.sources import watchlist

XML = """<sdnList xmlns="urn:list"><sdnEntry><uid>7</uid><firstName>Ana</firstName><lastName>Ruiz</lastName><sdnType>Individual</sdnType>
<akaList><aka><uid>1</uid><type>a.k.a.</type><category>weak</category><lastName>LA JEFA</lastName></aka></akaList>
<idList><id><uid>2</uid><idNumber>X1</idNumber></id></idList>
<dateOfBirthList><dateOfBirthItem><uid>3</uid><dateOfBirth>circa 1961</dateOfBirth><mainEntry>true</mainEntry></dateOfBirthItem></dateOfBirthList>
<nationalityList><nationality><uid>4</uid><country>Peru</country></nationality></nationalityList>
<citizenshipList><citizenship><uid>5</uid><country>Chile</country></citizenship></citizenshipList>
<addressList><address><uid>6</uid><city>Lima</city></address></addressList></sdnEntry>
<sdnEntry><uid>8</uid><lastName>ACME</lastName><sdnType>Entity</sdnType></sdnEntry></sdnList>"""


def test_evaluation_set(spark):
    names = spark.range(400).select(F.col("id").alias("name_id"), (F.col("id") * 2).alias("entity_id"), F.concat(F.lit("MARIA ELENA NAME"), "id").alias("raw"), F.lit(1960).alias("year"))
    rows = S.evaluation_set(names).collect()
    by = {k: [r for r in rows if r.label == k] for k in S.EVALUATED}
    assert {k: len(v) for k, v in by.items()} == S.EVALUATED and len({r.query_id for r in rows}) == 450
    assert all(r.true_entity is not None and r.year in (None, 1960) for r in by["true_match"]) and {r.year for r in by["true_match"]} == {None, 1960}
    assert all(r.true_entity is None and 1975 <= r.year <= 2000 for r in by["hard_negative"])
    assert all(r.true_entity is None and r.year is None and r.raw for r in by["clean"]) and len({r.raw for r in by["clean"]}) == 140
    assert sorted(rows) == sorted(S.evaluation_set(names.repartition(7)).collect())
    few = S.evaluation_set(names.limit(3)).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in few} == {"true_match": 3, "clean": 140}
    assert {r.label for r in S.evaluation_set(names.limit(0)).collect()} == {"clean"}


def test_baseline(spark):
    corpus = spark.createDataFrame([(1, 10, "ANA RUIZ"), (2, 11, "ANA RUIZ"), (3, 12, "IVAN")], "name_id long, entity_id long, normalized string")
    queries = spark.createDataFrame([(5, "RUIZ ANA"), (6, "")], "query_id long, normalized string")
    found = spark.createDataFrame([(5, 1), (5, 2), (5, 3), (6, 3)], "query_id long, name_id long")
    assert [tuple(r) for r in S.baseline(found, queries, corpus).collect()] == [(5, 10, 100.0)]


def test_children(spark, tmp_path):
    (tmp_path / "list.xml").write_text(XML)
    out = {k: sorted(map(tuple, v.collect())) for k, v in watchlist.children(watchlist.read_entries(spark, str(tmp_path))).items()}
    assert out["names"] == [(7, "Ana Ruiz", "primary", False), (7, "LA JEFA", "a.k.a.", True), (8, "ACME", "primary", False)]
    assert out["identifiers"] == [(7, "unknown", "X1", None)] and out["births"] == [(7, None, 1961, "circa 1961")]
    assert out["nationalities"] == [(7, "citizenship", "Chile"), (7, "nationality", "Peru")]
    assert out["addresses"] == [(7, None, None, "Lima", None, None, None)]


def test_append_only(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    more = old.unionByName(spark.createDataFrame([(3, "c")], "id long, v string"))
    assert C.require_appended(old, more, ["id"]) is more
    with pytest.raises(ValueError):
        C.require_appended(more, old, ["id"])
    with pytest.raises(ValueError):
        C.require_appended(old, old.fillna("x"), ["id"])


def test_countries(spark):
    known = papers.iso_countries(spark)
    assert len(known) > 200
    df = spark.createDataFrame([("KEN", "Kenya"), ("BR", " brazil"), ("PE", "PER"), ("PER", "Chile"), ("Atlantis", "atlantis"), (None, "Peru")], "a string, b string")
    assert [r[0] for r in df.select(papers.same_country(F.col("a"), F.col("b"), known)).collect()] == [True, True, True, False, True, None]
