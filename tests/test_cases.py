from pyspark.sql import functions as F

from tessera.functions import papers
from tessera.operators import cases as K


def test_dispositions(spark):
    hits = spark.createDataFrame([(1, 1, 7, 50.0, "pending", None), (2, 1, 7, 90.0, "pending", None), (3, 1, 8, 10.0, "pending", None)], "hit_id int, case_id int, tenant_id int, score double, disposition string, reason string")
    asked = spark.createDataFrame([(1, 7, "true_match", "confirmed_true_match", 5, 1), (1, 7, "false_positive", "confirmed_no_match", 6, 2), (2, 7, "x", "because", 5, 1), (3, 7, "x", "confirmed_no_match", 5, 1)], "hit_id int, tenant_id int, disposition string, reason string, actor_id int, at int")
    got = {r.hit_id: (r.disposition, r.reason, r.error) for r in K.dispose(hits, asked).collect()}
    assert got == {1: ("false_positive", "confirmed_no_match", None), 2: ("pending", None, "unknown reason"), 3: ("pending", None, "other tenant")}
    assert {r.hit_id for r in K.bulk_clear(hits, 60.0).where("disposition = 'false_positive'").collect()} == {1, 3}


def test_four_eyes(spark):
    rows = [(i, 1, tier, "PENDING_L2", 5, None, None) for i, tier in enumerate(["high_risk"] * 4 + ["review"] * 2)]
    c = spark.createDataFrame(rows, "case_id int, tenant_id int, tier string, state string, assignee_id int, decision string, decided_by int")
    asked = [(0, "reject", 5, False), (0, "reject", 6, True), (1, "reject", 5, False), (1, "reject", 5, True), (2, "reject", 6, True), (3, "approve", 9, False), (4, "clear", 5, False), (5, "reject", 5, False)]
    got = {r.case_id: (r.state, r.error) for r in K.decide(c, spark.createDataFrame([(*a, 1) for a in asked], "case_id int, decision string, actor_id int, second boolean, at int")).collect()}
    assert got == {0: ("REJECTED", None), 1: ("PENDING_L2", "same person twice"), 2: ("PENDING_L2", "no first approval"), 3: ("PENDING_L2", "not the assignee"), 4: ("CLEARED", None), 5: ("REJECTED", None)}
    assert {r.case_id for r in K.ask(c, spark.createDataFrame([(2,), (2,)], "case_id int")).where("state = 'RFI_REQUESTED'").collect()} == {2}


def test_zone_and_cross_references(spark):
    zone = "noise\nP<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
    rows = [(1, zone, "Anna Maria Eriksson", "1974-08-12", "UTO"), (2, zone.replace("7408122", "7408123"), "Anna", "x", ""), (3, "nothing", "A", None, None), (4, zone, "Someone Else", "1970-01-01", "Sweden")]
    df = spark.createDataFrame(rows, "id int, ocr string, name string, birth string, nation string").withColumn("zone", papers.zone(F.col("ocr")))
    z = {r.id: r.zone for r in df.collect()}
    assert z[1].valid and z[1].surname == "ERIKSSON" and z[1].given_names == "ANNA MARIA" and str(z[1].birth) == "1974-08-12" and z[1].number == "L898902C3" and z[3] is None and not z[2].valid
    out = {r.id: (r.status, r.issues) for r in papers.cross_references(df, "zone", "name", "birth", "nation", F.lit("2011-01-01").cast("date")).collect()}
    assert out[1] == ("pass", []) and out[3][0] == "warn" and out[4] == ("fail", ["name mismatch", "date of birth mismatch", "issuing country inconsistent"])


def test_small_rules(spark):
    ips = ["1.2.3.4", "256.1.1.1", "::1", "fe80::1:2", "1:2:3:4:5:6:7:8", "1::2::3", "x", None, "::", "1:2:3:4:5:6:7:8:9"]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(ips)], "i int, a string").orderBy("i").select(papers.address(F.col("a")).alias("x")).collect()]
    assert got == ["1.2.3.4", None, "::1", "fe80::1:2", "1:2:3:4:5:6:7:8", None, None, None, "::", None]
    codes = spark.createDataFrame([("ab-cd 12",)], "c string").select(F.array(papers.code_digest(F.lit("ABCD12")), papers.code_digest(F.lit("zz"))).alias("d"), "c").select(papers.spend_code(F.col("d"), F.col("c")).alias("s")).first().s
    assert codes.ok and len(codes.rest) == 1
    faults = papers.password_faults(spark.createDataFrame([("short",), ("Password12345",), ("a long enough one",)], "p string"), "p", spark.createDataFrame([("password12345",)], "word string"))
    assert {r.p: r.fault for r in faults.collect()} == {"short": "too short", "Password12345": "common", "a long enough one": None}
