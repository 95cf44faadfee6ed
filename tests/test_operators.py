import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import changes as C
from tessera.operators import decisions as D
from tessera.operators import history as H
from tessera.operators import screening as S
from tessera.operators import tenancy
from tessera.sources import watchlist

T = dt.datetime(2024, 1, 1)


def routed(spark, score, risk="low", doc="pass", corroborated=False):
    df = spark.createDataFrame([(score, risk, doc, corroborated)], "s double, r string, d string, c boolean")
    return df.select(D.route(F.col("s"), F.col("r"), F.col("d"), F.col("c")).alias("x")).first()["x"]


def test_routing(spark):
    tier = lambda *a, **k: routed(spark, *a, **k)["tier"]
    assert tier(99.0, doc="fail") == "reject"
    assert routed(spark, 90.0, corroborated=True).asDict() == {"tier": "high_risk", "reason": "strong match with corroboration", "sla_hours": 4, "dual": True}
    assert tier(95.0) == "review" and tier(72.0) == "clear" and tier(72.5) == "review"
    assert tier(0.0, risk="high") == "review" and tier(0.0, doc="warn") == "review" and tier(None) == "clear"


def test_confusion(spark):
    rows = [("true_match", 1, 1, 90.0), ("true_match", 2, 3, 90.0), ("true_match", 4, None, None), ("clean", None, 9, 80.0), ("clean", None, None, None)]
    m = D.confusion(spark.createDataFrame(rows, "label string, true_entity long, top_entity long, top_score double"), [75, 95]).orderBy("threshold").collect()
    assert [(r.tp, r.fp, r.fn, r.tn) for r in m] == [(1, 1, 2, 1), (0, 0, 3, 2)]
    assert m[1].precision == m[1].f1 == 0.0
    assert D.thresholds_sweep() == [50, 55, 60, 65, 70, 72, 75, 80, 85, 89, 90, 95]


def test_snapshot(spark):
    new1 = spark.createDataFrame([("L", 1, "f1", "A"), ("L", 2, "f2", "B")], "source string, uid int, fingerprint string, name string")
    none = new1.limit(0).withColumns({"first_seen_version": F.lit(1), "last_seen_version": F.lit(1), "is_active": F.lit(True)})
    first = C.upserted(none.drop("is_active"), new1, ["source", "uid"], 1)
    assert C.load_stats(C.compare(none, new1, ["source", "uid"]), first).first().asDict() == {"added": 2, "removed": 0, "modified": 0, "unchanged": 0, "total_active": 2}
    new2 = spark.createDataFrame([("L", 1, "f1", "A"), ("L", 3, "f3", "C")], "source string, uid int, fingerprint string, name string")
    changes = C.compare(first, new2, ["source", "uid"])
    second = C.upserted(first.drop("is_active"), new2, ["source", "uid"], 2)
    assert C.load_stats(changes, second).first().asDict() == {"added": 1, "removed": 1, "modified": 0, "unchanged": 1, "total_active": 2}
    assert {(r.uid, r.is_active, r.last_seen_version) for r in second.collect()} == {(1, True, 2), (2, False, 1), (3, True, 2)}
    diff = {r.uid: r.diff for r in C.change_rows(first, new2, changes, ["source", "uid"], ["name"], ["name"], "name").collect()}
    assert diff == {2: '{"name":"B"}', 3: '{"name":"C"}'}


def test_history(spark):
    log = spark.createDataFrame([(1, i, f"p{i}") for i in range(5)] + [(None, i, f"q{i}") for i in range(3)], "tenant int, id int, body string")
    chained = H.append_chained(spark, log, "tenant", "id", "body")
    want = hashlib.sha256((H.GENESIS + "p0").encode()).hexdigest()
    assert chained.where("tenant = 1 and id = 0").first()["hash"] == want
    assert all(r.first_broken is None for r in H.chain_faults(chained, "tenant", "id", F.col("body")).collect())
    spoiled = chained.withColumn("body", F.when((F.col("id") == 2) & F.col("tenant").isNull(), "x").otherwise(F.col("body")))
    assert {r.tenant: r.first_broken for r in H.chain_faults(spoiled, "tenant", "id", F.col("body")).collect()} == {1: None, None: 2}
    logins = spark.createDataFrame([(1, i, ok) for i, ok in enumerate([False] * 7 + [True, False])], "u int, at int, ok boolean")
    runs = H.failure_runs(logins, "u", ["at"], ~F.col("ok")).orderBy("at").collect()
    assert [r.run_length for r in runs] == [1, 2, 3, 4, 5, 6, 7, 1] and [r.lock_seconds for r in runs] == [0, 0, 0, 0, 30, 60, 120, 0]
    steps = spark.createDataFrame([(1, 0, "DRAFT"), (1, 1, "SUBMITTED"), (1, 2, "APPROVED")], "k int, at int, state string")
    assert [r.state for r in H.bad_transitions(steps, "k", ["at"], "state", H.edge_table(spark)).collect()] == ["APPROVED"]
    tokens = spark.createDataFrame([(1, 2), (2, 3), (3, None), (9, 1)], "id long, replaced_by_id long")
    assert {(r.id, r.depth) for r in H.replaced_chain(spark, tokens, 1).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_adjustments_and_composite(spark):
    def score(birth="1960-05-01", nation="Iran", ident="z", kind="individual", weak=False, base=90.0):
        df = spark.createDataFrame([(base, weak)], "base double, weak boolean")
        entity = {"dobs": F.array(F.lit("1960-05-01").cast("date")), "dob_years": F.array(F.lit(1960)), "nationalities": F.array(F.lit(" IRAN ")), "id_numbers": F.array(F.lit("ab1 ")), "sdn_type": F.lit("Individual")}
        changes, forced = S.adjustments(F.lit(birth).cast("date"), F.lit(nation), F.lit(ident), F.lit(kind), entity)
        row = df.select(S.composite(F.col("base"), changes, forced, F.col("weak")).alias("s"), changes.alias("c")).first()
        return row["s"], dict(row["c"])

    assert score(base=50.0) == (65.0, {"dob_exact_match": 10.0, "nationality_match": 5.0})
    assert score("1960-06-01", "Cuba") == (85.0, {"dob_year_match": 5.0, "nationality_conflict": -10.0})
    assert score("1962-06-01", "", kind="entity") == (60.0, {"entity_type_mismatch": -30.0})
    assert score("1963-06-01", "")[1] == {"dob_conflict": -25.0}
    assert score(ident=" AB1", weak=True, base=10.0) == (100.0, {})
    assert score(weak=True)[0] == 80.0 and score()[0] == 100.0


def test_screening_finds_respelled_names(spark):
    raw = ["Mohammad Ali Hassan", "Acme Trading Ltd", "Maria Gonzalez", "Ivan Petrov"]
    from tessera.functions import fuzzy, text

    names = spark.createDataFrame(list(enumerate(raw)), "name_id long, raw string").select("name_id", F.col("name_id").alias("entity_id"), text.normalized(F.col("raw")).alias("n")).select("name_id", "entity_id", "n.*")
    names = names.withColumns({"phonetic": fuzzy.phonetic_keys("tokens"), "embedding": S.hashed_embedding(F.col("normalized")), "is_active": F.lit(True)})
    asked = ["Muhammad Hassan Ali", "Maria Gonzales", "Zzz Qqq"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, raw string").select("query_id", text.normalized(F.col("raw")).alias("n")).select("query_id", "n.*")
    q = q.withColumns({"phonetic": fuzzy.phonetic_keys("tokens"), "embedding": S.hashed_embedding(F.col("normalized"))})
    stats = S.token_stats(names)
    best = {r.query_id: (r.entity_id, r.score) for r in S.ranked(S.scored(S.candidates(q, names, stats), q, names, stats)).where("rank = 1").collect()}
    assert best[0] == (0, 100.0) and best[1][0] == 2 and best[1][1] > 85 and 2 not in best


def test_analytics_edges(spark):
    empty = spark.createDataFrame([], "id int, due timestamp, state string")
    assert A.sla(empty, F.col("state") == "open", F.col("due"), F.lit(T)).first().asDict() == {"breached": 0, "on_track": 0}
    rows = [(1, T - dt.timedelta(1), "open"), (2, None, "open"), (3, T, "open"), (4, T - dt.timedelta(9), "done")]
    assert A.sla(spark.createDataFrame(rows, empty.schema), F.col("state") == "open", F.col("due"), F.lit(T)).first().asDict() == {"breached": 1, "on_track": 2}
    statuses = spark.createDataFrame([(1, "pass"), (1, "warn"), (2, None), (3, "fail"), (3, "pass")], "k int, s string")
    assert {r.k: r.worst for r in A.worst_of(statuses, "k", F.col("s")).collect()} == {1: "warn", 2: None, 3: "fail"}
    calls = spark.createDataFrame([("a", "cached", 1, None), ("a", "ok", 2, 3), ("b", "ok", None, 4), ("b", "cached", 1, 1)], "p string, s string, x int, y int")
    used = A.usage(calls, F.col("p"), F.col("s"), F.col("x") + F.col("y")).collect()
    assert {(r.provider, r.status): r.tokens for r in used} == {("a", "cached"): 0, ("a", "ok"): 5, ("b", "ok"): 0, ("b", "cached"): 2} and {r.cache_rate for r in used} == {0.5}
    with pytest.raises(Exception, match="too few"):
        A.require_floor(calls, 10).collect()


def test_scoping(spark):
    df = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, tenant_id int")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(tenancy.scoped(df, 7)) == [1] and ids(tenancy.scoped(df, None)) == [] and ids(tenancy.scoped(df, 7, shared=True)) == [1, 3] and ids(tenancy.scoped(df, None, shared=True)) == [3]
    people = spark.createDataFrame([(1, "auditor"), (2, "customer"), (3, "nobody")], "id int, role string")
    assert ids(tenancy.allowed(people, tenancy.grants(spark), "audit:read")) == [1]


XML = """<?xml version="1.0"?>
<sdnList xmlns="http://lists.example.org/v1"><publshInformation><Publish_Date>03/04/2024</Publish_Date><Record_Count>2</Record_Count></publshInformation>
<sdnEntry><uid>10</uid><firstName> Ana </firstName><lastName>Doe</lastName><sdnType>Individual</sdnType><programList><program>P1</program><program>P2</program></programList>
<akaList><aka><uid>1</uid><type>a.k.a.</type><category>weak</category><lastName>D</lastName></aka></akaList>
<dateOfBirthList><dateOfBirthItem><uid>3</uid><dateOfBirth>19 Jun 1951</dateOfBirth><mainEntry>true</mainEntry></dateOfBirthItem></dateOfBirthList></sdnEntry>
<sdnEntry><uid>{uid}</uid><lastName>Acme</lastName><sdnType>Entity</sdnType></sdnEntry></sdnList>"""


def test_watchlist(spark, tmp_path):
    good, bad = tmp_path / "good.xml", tmp_path / "bad.xml"
    good.write_text(XML.replace("{uid}", "11"))
    bad.write_text(XML.replace("{uid}", ""))
    rows = {r.uid: r for r in watchlist.read_entries(spark, str(good), "http://lists.example.org/v1").collect()}
    assert rows[10].primary_name == "Ana Doe" and rows[11].primary_name == "Acme" and rows[10].programs == ["P1", "P2"] and rows[11].programs == []
    assert rows[10].akas[0].category == "weak" and rows[10].births[0].main is True and rows[11].nationalities == []
    head = watchlist.read_header(spark, str(good)).first()
    assert (str(head.publish_date), head.record_count) == ("2024-03-04", 2)
    assert watchlist.read_entries(spark, str(good), "http://other.example.org").count() == 0
    with pytest.raises(Exception, match="no uid"):
        watchlist.read_entries(spark, str(bad)).collect()
    digest = hashlib.sha256(good.read_bytes()).hexdigest()
    known = spark.createDataFrame([(digest,)], "sha256 string")
    assert {r.path.rsplit("/", 1)[1]: r.changed for r in watchlist.content_versions(spark, str(tmp_path), known).collect()} == {"good.xml": False, "bad.xml": True}
    watchlist.publish(spark.range(3).toDF("id"), str(tmp_path / "t"), "v1")
    watchlist.publish(spark.range(5).toDF("id"), str(tmp_path / "t"), "v2")
    assert watchlist.current(spark, str(tmp_path / "t")).count() == 5
    with pytest.raises(Exception, match="already exists"):
        watchlist.publish(spark.range(9).toDF("id"), str(tmp_path / "t"), "v1")
    assert watchlist.current(spark, str(tmp_path / "t")).count() == 5
    with pytest.raises(ValueError, match="nothing was published"):
        watchlist.current(spark, str(tmp_path / "none"))
    views = {"mv_a": spark.range(2), "other": spark.range(4)}
    assert watchlist.refresh_views(views, str(tmp_path), "v1") == ["mv_a"] and watchlist.current(spark, str(tmp_path / "mv_a")).count() == 2


def test_csv_round_trip(spark, tmp_path):
    rows = [("Ana Doe", 1951, "true_match", 10), ("Bo", None, "clean", None)]
    df = spark.createDataFrame(rows, watchlist.GROUND_TRUTH)
    watchlist.write_csv(df, str(tmp_path / "g"))
    assert sorted(map(tuple, watchlist.read_ground_truth(spark, str(tmp_path / "g")).collect()), key=str) == sorted(rows, key=str)


def test_quantiles(spark):
    rng = __import__("random").Random(1)
    values = [rng.randrange(500) for _ in range(3000)] + [7] * 2000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    for q in (0.0, 0.5, 0.95, 0.999):
        assert A.nearest_rank(df, "v", q).first()["p"] == sorted(values)[int(len(values) * q)]
    assert A.nearest_rank(df.limit(0), "v", 0.5).first()["p"] is None
    buckets = spark.createDataFrame([(1.0, 10), (2.0, 30), (float("inf"), 40)], "le double, n long")
    assert [A.interpolated_quantile(buckets, q).first()["p"] for q in (0.125, 0.5, 0.9)] == [0.5, 1.5, 2.0]
    assert A.interpolated_quantile(buckets.limit(0), 0.5).first()["p"] is None


def test_streams_equal_batches(spark, tiny, tmp_path):
    from tessera.streaming import windows

    (tmp_path / "in").mkdir()
    events = spark.read.parquet(f"{tiny}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in" / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "e"))
    out = windows.bucketed(stream, "event_type", "ts", F.lit(1), "1 day", "1 hour")
    q = out.writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = {(r.event_type, str(r.day)): r.requests for r in spark.sql("SELECT event_type, w.start AS day, requests FROM days").collect()}
    want = {(r.event_type, str(r.day)): r.n for r in events.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_breaker_stream(spark, tmp_path):
    from tessera.streaming import windows

    at = lambda s: T + dt.timedelta(seconds=s)
    rows = [("p", at(i * 10), False) for i in range(5)] + [("p", at(60), True), ("p", at(70), False), ("p", at(200), False)]
    spark.createDataFrame(rows, "provider string, ts timestamp, ok boolean").coalesce(1).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("provider string, ts timestamp, ok boolean").parquet(str(tmp_path / "calls"))
    q = windows.breaker(stream, "provider", "ts", "ok").writeStream.outputMode("append").format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.failures, r.open) for r in spark.sql("SELECT * FROM breaker ORDER BY ts").collect()]
    assert got == [(1, False), (2, False), (3, False), (4, False), (5, True), (0, False), (1, False), (1, False)]
