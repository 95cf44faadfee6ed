"""Risk, routing, tenancy, privacy and change tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import fuzzy, papers, secrecy, text
from tessera.operators import analytics as A
from tessera.operators import cases, tenancy
from tessera.operators import changes as C
from tessera.operators import decisions as D
from tessera.session import table

from .registry import query

KEY = b"index-key"
DAY_TEXT = "yyyy-MM-dd"


def countries(spark):
    return spark.createDataFrame([("nation_%d" % i, level) for i, (_, level) in enumerate(D.COUNTRY_RISK)], "country string, risk_level string")


def profiles(spark, d):
    """Customers in the shape that the risk rules read."""
    volume = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("volume"))
    c = table(spark, d, "customer").join(volume, F.col("c_custkey") == F.col("o_custkey"), "left")
    key = F.col("c_custkey")
    return c.select(
        "c_custkey", "c_acctbal", F.concat(F.lit("nation_"), F.col("c_nationkey")).alias("nationality"), F.when(key % 5 != 0, F.concat(F.lit("nation_"), (F.col("c_nationkey") + 3).cast("int"))).alias("residence_country"),
        F.when(key % 11 == 0, "Casino owner").when(key % 7 == 0, "Import and export").otherwise(F.lower("c_mktsegment")).alias("occupation"), F.floor(F.coalesce("volume", F.lit(0.0)) / 10).cast("long").alias("expected_monthly_volume"),
        F.when(key % 3 == 0, "entity").otherwise("individual").alias("customer_type"), F.when(key % 13 == 0, "fail").when(key % 9 == 0, "warn").when(key % 4 != 0, "pass").alias("document_check_status"),
    )


SQL_PROFILES = """
country_risk AS (SELECT 'nation_' || i AS country, level FROM (SELECT unnest(range(15)) AS i, unnest(['high','high','high','high','high','medium','medium','medium','medium','medium','low','low','low','low','low']) AS level)),
profiles AS (
  SELECT c_custkey, c_acctbal, 'nation_' || c_nationkey AS nationality, CASE WHEN c_custkey % 5 <> 0 THEN 'nation_' || (c_nationkey + 3) END AS residence_country,
    CASE WHEN c_custkey % 11 = 0 THEN 'Casino owner' WHEN c_custkey % 7 = 0 THEN 'Import and export' ELSE lower(c_mktsegment) END AS occupation,
    CAST(floor(coalesce(volume, 0) / 10) AS BIGINT) AS expected_monthly_volume, CASE WHEN c_custkey % 3 = 0 THEN 'entity' ELSE 'individual' END AS customer_type,
    CASE WHEN c_custkey % 13 = 0 THEN 'fail' WHEN c_custkey % 9 = 0 THEN 'warn' WHEN c_custkey % 4 <> 0 THEN 'pass' END AS document_check_status
  FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS volume FROM orders GROUP BY 1) ON o_custkey = c_custkey),
levels AS (
  SELECT p.*, coalesce(a.level, 'medium') AS nationality_level, coalesce(b.level, 'medium') AS residence_level,
    CASE WHEN regexp_matches(lower(occupation), 'politically exposed|government official|minister|military officer|money service|money exchange|currency exchange|casino|arms dealer|precious metals dealer') THEN 'high'
      WHEN regexp_matches(lower(occupation), 'real estate|jewelry|import|export|cash|consultant') THEN 'medium' ELSE 'low' END AS occupation_level,
    CASE WHEN expected_monthly_volume >= 250000 THEN 'high' WHEN expected_monthly_volume >= 50000 THEN 'medium' ELSE 'low' END AS volume_level,
    CASE WHEN customer_type = 'entity' THEN 'medium' ELSE 'low' END AS opacity_level,
    CASE document_check_status WHEN 'fail' THEN 'high' WHEN 'warn' THEN 'medium' ELSE 'low' END AS document_level
  FROM profiles p LEFT JOIN country_risk a ON a.country = nationality LEFT JOIN country_risk b ON b.country = residence_country),
risks AS (SELECT *, CASE WHEN list_contains([nationality_level, residence_level, occupation_level, volume_level, opacity_level, document_level], 'high') THEN 'high'
  WHEN list_contains([nationality_level, residence_level, occupation_level, volume_level, opacity_level, document_level], 'medium') THEN 'medium' ELSE 'low' END AS risk FROM levels)
"""


@query("risk_factors", f"WITH {SQL_PROFILES} SELECT c_custkey, nationality_level, residence_level, occupation_level, volume_level, opacity_level, document_level, risk FROM risks")
def risk_factors(spark, d):
    out = D.customer_risk(profiles(spark, d), countries(spark))
    return out.select("c_custkey", *[f"{n}_level" for n in ("nationality", "residence", "occupation", "volume", "opacity", "document")], "risk")


@query("dim_default", f"WITH {SQL_PROFILES} SELECT n_nationkey, coalesce(level, 'medium') AS level FROM nation LEFT JOIN country_risk ON country = 'nation_' || n_nationkey")
def dim_default(spark, d):
    n = table(spark, d, "nation").withColumn("country_name", F.concat(F.lit("nation_"), "n_nationkey"))
    return D.with_country_level(n, "country_name", countries(spark), "level").select("n_nationkey", "level")


@query("max_level", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_mktsegment = 'MACHINERY' THEN 'high' WHEN c_acctbal < 1000 THEN 'medium' ELSE 'low' END AS level FROM customer""")
def max_level(spark, d):
    balance = F.when(F.col("c_acctbal") < 0, "high").when(F.col("c_acctbal") < 1000, "medium").otherwise("low")
    segment = F.when(F.col("c_mktsegment") == "MACHINERY", "high").otherwise("low")
    return table(spark, d, "customer").select("c_custkey", D.worst_level(balance, segment).alias("level"))


@query("route_cases", f"""
WITH {SQL_PROFILES},
s AS (SELECT *, CASE WHEN c_custkey % 17 <> 0 THEN abs(c_acctbal) / 100 END AS score, c_custkey % 2 = 0 AS corroborated FROM risks),
t AS (SELECT *, CASE WHEN document_check_status = 'fail' THEN 'reject' WHEN coalesce(score, 0) >= 90 AND corroborated THEN 'high_risk' WHEN coalesce(score, 0) > 72 THEN 'review'
  WHEN risk = 'high' THEN 'review' WHEN document_check_status = 'warn' THEN 'review' ELSE 'clear' END AS tier FROM s)
SELECT c_custkey, tier, CAST(CASE tier WHEN 'review' THEN 24 WHEN 'high_risk' THEN 4 END AS INTEGER) AS sla_hours, tier = 'high_risk' AS dual,
  CASE tier WHEN 'clear' THEN 'AUTO_APPROVED' WHEN 'review' THEN 'PENDING_L1' WHEN 'high_risk' THEN 'PENDING_L2' ELSE 'SYSTEM_REJECTED' END AS application_state FROM t""")
def route_cases(spark, d):
    r = D.customer_risk(profiles(spark, d), countries(spark))
    score = F.when(F.col("c_custkey") % 17 != 0, F.abs("c_acctbal") / 100)
    r = r.withColumn("r", D.route(score, F.col("risk"), F.col("document_check_status"), F.col("c_custkey") % 2 == 0))
    return r.select("c_custkey", "r.tier", "r.sla_hours", "r.dual", D.outcome(F.col("r.tier"))["application_state"].alias("application_state"))


@query("keyword_risk", """
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'politically exposed|government official|minister|military officer|money service|money exchange|currency exchange|casino|arms dealer|precious metals dealer') THEN 'high'
  WHEN regexp_matches(lower(text), 'real estate|jewelry|import|export|cash|consultant') THEN 'medium' ELSE 'low' END AS level FROM documents""")
def keyword_risk(spark, d):
    return table(spark, d, "documents").select("doc_id", D.occupation_level(F.col("text")).alias("level"))


SQL_V = """
v1 AS (SELECT p_partkey, sha256(p_name || '|' || p_brand || '|' || p_size) AS print, p_name, p_partkey % 19 <> 4 AS active FROM part WHERE p_partkey % 23 <> 5),
v2 AS (SELECT p_partkey, sha256(p_name || '|' || CASE WHEN p_partkey % 29 = 1 THEN 'changed' ELSE p_brand END || '|' || p_size) AS print, p_name FROM part WHERE p_partkey % 31 <> 8),
diff AS (SELECT coalesce(v1.p_partkey, v2.p_partkey) AS p_partkey, CASE WHEN v1.p_partkey IS NULL THEN 'added' WHEN v2.p_partkey IS NULL THEN CASE WHEN v1.active THEN 'removed' END
  WHEN v1.print <> v2.print THEN 'modified' ELSE 'unchanged' END AS change_type FROM v1 FULL JOIN v2 ON v1.p_partkey = v2.p_partkey)
"""


def snapshots(spark, d):
    """Two versions of the part list that differ by rule."""
    p = table(spark, d, "part")
    mark = lambda brand: F.sha2(F.concat_ws("|", "p_name", brand, F.col("p_size").cast("string")), 256)
    old = p.where("p_partkey % 23 <> 5").select("p_partkey", mark(F.col("p_brand")).alias("fingerprint"), "p_name", (F.col("p_partkey") % 19 != 4).alias("is_active"))
    new = p.where("p_partkey % 31 <> 8").select("p_partkey", mark(F.when(F.col("p_partkey") % 29 == 1, "changed").otherwise(F.col("p_brand"))).alias("fingerprint"), "p_name")
    return old, new


@query("snapshot_diff", f"WITH {SQL_V} SELECT p_partkey, change_type FROM diff WHERE change_type IS NOT NULL")
def snapshot_diff(spark, d):
    return C.compare(*snapshots(spark, d), ["p_partkey"])


@query("load_stats", f"""
WITH {SQL_V} SELECT count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed, count(*) FILTER (change_type = 'modified') AS modified,
  count(*) FILTER (change_type = 'unchanged') AS unchanged, (SELECT count(*) FROM v2) AS total_active FROM diff""")
def load_stats(spark, d):
    old, new = snapshots(spark, d)
    entities = C.upserted(old.drop("is_active").withColumns({"first_seen_version": F.lit(1), "last_seen_version": F.lit(1)}), new, ["p_partkey"], 2)
    return C.load_stats(C.compare(old, new, ["p_partkey"]), entities)


@query("upserted_entities", f"""
WITH {SQL_V} SELECT coalesce(v1.p_partkey, v2.p_partkey) AS p_partkey, coalesce(v2.print, v1.print) AS fingerprint, v2.p_partkey IS NOT NULL AS is_active,
  CAST(CASE WHEN v1.p_partkey IS NULL THEN 2 ELSE 1 END AS INTEGER) AS first_seen_version, CAST(CASE WHEN v2.p_partkey IS NULL THEN 1 ELSE 2 END AS INTEGER) AS last_seen_version FROM v1 FULL JOIN v2 ON v1.p_partkey = v2.p_partkey""")
def upserted_entities(spark, d):
    old, new = snapshots(spark, d)
    return C.upserted(old.drop("is_active").withColumns({"first_seen_version": F.lit(1), "last_seen_version": F.lit(1)}), new, ["p_partkey"], 2).drop("p_name")


@query("fingerprint_sha", """
SELECT o_custkey, sha256('{"f0":' || o_custkey || ',"f1":["' || array_to_string(list_sort(list(o_orderkey || ':' || o_orderstatus)), '","') || '"]}') AS print FROM orders GROUP BY 1""")
def fingerprint_sha(spark, d):
    """The engine's fingerprint of each customer: its key and its orders, in order."""
    item = F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus")
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return lists.select("o_custkey", C.fingerprint([F.col("o_custkey"), F.col("items")]).alias("print"))


@query("affected_keys", f"""
WITH {SQL_V} SELECT DISTINCT o_custkey AS customer_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey IN (SELECT p_partkey FROM diff WHERE change_type IN ('added', 'removed', 'modified'))""")
def affected_keys(spark, d):
    changed = C.compare(*snapshots(spark, d), ["p_partkey"]).where("change_type <> 'unchanged'").select(F.col("p_partkey").alias("entity_id"))
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("entity_id"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("customer_id"))
    return C.affected(changed, hits, runs)


@query("vector_reuse", """
WITH k AS (SELECT vec_id, CAST(label AS VARCHAR) AS norm, embedding FROM embeddings WHERE vec_id % 3 <> 0)
SELECT e.vec_id, k.vec_id IS NOT NULL AS reused FROM embeddings e LEFT JOIN k ON k.vec_id = e.vec_id AND k.norm = CAST(e.label AS VARCHAR)""")
def vector_reuse(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("norm"), "embedding")
    return C.to_embed(e.drop("embedding"), e.where("vec_id % 3 <> 0"), ["vec_id", "norm"]).select("vec_id", F.col("embedding").isNotNull().alias("reused"))


@query("tenant_scope", "SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey END AS tenant_id FROM customer WHERE c_custkey % 6 = 0 OR c_nationkey = 7")
def tenant_scope(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.col("c_nationkey")).alias("tenant_id"))
    return tenancy.scoped(c, 7, shared=True)


@query("role_grants", """
SELECT c_custkey, 'cases:read' AS permission FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""")
def role_grants(spark, d):
    roles = {"AUTOMOBILE": "auditor", "BUILDING": "compliance_analyst", "MACHINERY": "senior_reviewer", "HOUSEHOLD": "customer", "FURNITURE": "customer"}
    held = table(spark, d, "customer").select("c_custkey", F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])[F.col("c_mktsegment")].alias("role"))
    return tenancy.allowed(held, tenancy.grants(spark), "cases:read").select("c_custkey", "permission")


@query("mask_fields", "SELECT c_custkey, '***' AS full_name, '***' AS phone, c_mktsegment FROM customer")
def mask_fields(spark, d):
    return secrecy.masked(table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("full_name"), F.col("c_nationkey").alias("phone"), "c_mktsegment"))


SQL_PADS = [bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x5C, 0x36)]
SQL_MAC = f"sha256(from_hex('{SQL_PADS[0]}') || from_hex(sha256(from_hex('{SQL_PADS[1]}') || encode({{}}))))"


@query("blind_index", f"SELECT c_custkey, {SQL_MAC.format('lower(trim(c_name))')} AS blind FROM customer")
def blind_index(spark, d):
    return table(spark, d, "customer").select("c_custkey", secrecy.blind_index(KEY, F.col("c_name")).alias("blind"))


SQL_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS INTEGER), 3)))))"
# codes of the market segments, which are all the words that the phonetic functions meet here
SEGMENT_CODES = {"AUTOMOBILE": ("ATANABAL", "ATMBL"), "BUILDING": ("BALDANG", "BLTNK"), "FURNITURE": ("FARNATAR", "FRNTR"), "HOUSEHOLD": ("HASAHALD", "HSHLT"), "MACHINERY": ("MCANARY", "MXNR")}
SQL_CODE = lambda i: "CASE c_mktsegment " + " ".join(f"WHEN '{w}' THEN '{c[i]}'" for w, c in SEGMENT_CODES.items()) + " END"


@query("sql_functions", f"""
WITH c AS (SELECT *, 'Customer ' || c_custkey AS other FROM customer), g AS (SELECT *, {SQL_GRAMS.format('c_name')} AS x, {SQL_GRAMS.format('other')} AS y FROM c)
SELECT c_custkey, replace(upper(c_name), '#', ' ') AS normalized, {SQL_CODE(0)} AS nysiis_code, {SQL_CODE(1)} AS metaphone_code, round(200.0 * length(c_name) / (2 * length(c_name) + 1), 6) AS indel,
  100.0 AS sorted_words, 100.0 AS word_sets, round(100 * jaro_winkler_similarity(c_name, c_name || 'x'), 6) AS winkler, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS grams,
  '{{"a":"' || c_name || '","b":' || c_nationkey || '}}' AS canonical, {SQL_MAC.format('c_name')} AS mac FROM g""")
def sql_functions(spark, d):
    """The library's ten functions called by name from SQL; their work is far more than a row's bytes, so a file's rows are dealt to all cores."""
    fuzzy.register(spark)
    rows = table(spark, d, "customer").repartition(2 * spark.sparkContext.defaultParallelism).selectExpr("*", "concat('Customer ', c_custkey) AS other")
    return rows.selectExpr(
        "c_custkey", "normalize_name(c_name) AS normalized", "nysiis(c_mktsegment) AS nysiis_code", "metaphone(c_mktsegment) AS metaphone_code", "round(indel_ratio(c_name, concat(c_name, 'x')), 6) AS indel",
        "token_sort_ratio(concat(c_name, ' ', c_mktsegment), concat(c_mktsegment, ' ', c_name)) AS sorted_words", "token_set_ratio(c_name, concat(c_name, ' ', c_mktsegment)) AS word_sets",
        "round(jaro_winkler(c_name, concat(c_name, 'x')), 6) AS winkler", "round(trigram_similarity(c_name, other), 6) AS grams",
        "canonical_json(to_json(named_struct('b', c_nationkey, 'a', c_name))) AS canonical", f"hmac_sha256('{KEY.decode()}', c_name) AS mac")


@query("minimal_payloads", """
WITH h AS (SELECT o_custkey, o_orderkey, o_orderpriority AS name, floor(o_totalprice) / 8 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice) DESC, o_orderkey) AS place FROM orders),
t AS (SELECT o_custkey, string_agg(name || ' ' || printf('%.1f', round(score, 1)), ';' ORDER BY place) AS hits, min(o_orderkey) FILTER (place = 1) AS best FROM h WHERE place <= 3 GROUP BY 1)
SELECT c_custkey, 'C' || c_custkey AS alias, c_mktsegment AS tier, CASE WHEN c_custkey % 3 <> 0 THEN CAST(strftime(o_orderdate, '%Y') AS INTEGER) END AS birth_year, substr(text, 1, 160) AS remarks, coalesce(hits, '') AS hits
FROM customer LEFT JOIN t ON o_custkey = c_custkey LEFT JOIN orders o ON o.o_orderkey = best LEFT JOIN documents ON doc_id = best""")
def minimal_payloads(spark, d):
    """What may leave for an outside model: the three best hits of each customer, the remarks that the best one has, a year for a birth date."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("name"), F.floor("o_totalprice").alias("total"), F.date_format("o_orderdate", DAY_TEXT).alias("day"))
    best = A.top_per_group(o, ["o_custkey"], [F.desc("total"), F.asc("o_orderkey")], 3)
    hit = F.struct("rank", "name", (F.col("total") / 8).alias("score"), "o_orderkey", "day")
    hits = best.groupBy("o_custkey").agg(F.array_sort(F.collect_list(hit)).alias("hits")).withColumn("best", F.col("hits")[0]["o_orderkey"])
    remarks = table(spark, d, "documents").select(F.col("doc_id").alias("best"), F.col("text").alias("remarks"))
    rows = table(spark, d, "customer").join(hits, F.col("c_custkey") == F.col("o_custkey"), "left").join(remarks, "best", "left")
    birth = F.when(F.col("c_custkey") % 3 != 0, F.col("hits")[0]["day"]).otherwise("not a date")
    sent = rows.select("c_custkey", secrecy.minimal_payload(F.col("hits"), F.concat(F.lit("C"), "c_custkey"), F.col("c_mktsegment"), birth, F.col("remarks")).alias("p")).select("c_custkey", "p.*")
    return sent.withColumn("hits", F.coalesce(F.array_join(F.transform("hits", lambda h: F.concat(h["name"], F.lit(" "), F.format_string("%.1f", h["score"]))), ";"), F.lit("")))


@query("template_summaries", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'Case ' || c_custkey || ', tier review. Top match: ' || c_name || ' (score ' || CAST(c_nationkey AS VARCHAR) || ').' ELSE 'Case ' || c_custkey || ', tier review. No screening hits recorded.' END AS summary FROM customer")
def template_summaries(spark, d):
    has = F.col("c_acctbal") >= 0
    out = secrecy.template_summary(F.col("c_custkey").cast("string"), F.lit("review"), F.when(has, F.col("c_name")), F.when(has, F.col("c_nationkey")))
    return table(spark, d, "customer").select("c_custkey", out.alias("summary"))


@query("dob_parse", """
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d %b %Y') WHEN 1 THEN 'circa ' || strftime(o_orderdate, '%Y') WHEN 2 THEN strftime(o_orderdate, '%Y') || ' to 1999' ELSE 'unknown' END AS dob FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(strptime(dob, '%d %b %Y'), '%Y-%m-%d') END AS exact, CAST(nullif(regexp_extract(dob, '([0-9]{4})', 1), '') AS INTEGER) AS year FROM s""")
def dob_parse(spark, d):
    k = F.col("o_orderkey") % 4
    dob = F.when(k == 0, F.date_format("o_orderdate", "dd MMM yyyy")).when(k == 1, F.concat(F.lit("circa "), F.date_format("o_orderdate", "yyyy"))).when(k == 2, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(" to 1999"))).otherwise("unknown")
    p = text.parse_birth(dob)
    return table(spark, d, "orders").select("o_orderkey", F.date_format(p["exact"], "yyyy-MM-dd").alias("exact"), p["year"].alias("year"))


@query("mrz_dates", """
SELECT o_orderkey, strftime(CASE WHEN CAST(strftime(o_orderdate, '%y') AS INTEGER) >= 50 THEN o_orderdate ELSE o_orderdate END, '%Y-%m-%d') AS born FROM orders""")
def mrz_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format(text.mrz_date(F.date_format("o_orderdate", "yyMMdd")), "yyyy-MM-dd").alias("born"))


SQL_CASES = """
cases AS (SELECT o_orderkey AS case_id, o_custkey % 5 AS tenant_id, CASE WHEN o_orderpriority < '3' THEN 'high_risk' ELSE 'review' END AS tier, CASE WHEN o_orderpriority < '3' THEN 'PENDING_L2' ELSE 'PENDING_L1' END AS state,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 20 END AS assignee_id FROM orders WHERE o_orderstatus = 'O')
"""


def work(spark, d):
    """Orders as cases."""
    high = F.col("o_orderpriority") < "3"
    return table(spark, d, "orders").where("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("case_id"), (F.col("o_custkey") % 5).alias("tenant_id"), F.when(high, "high_risk").otherwise("review").alias("tier"), F.when(high, "PENDING_L2").otherwise("PENDING_L1").alias("state"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 20).alias("assignee_id"), F.lit(None).cast("string").alias("decision"), F.lit(None).cast("long").alias("decided_by"))


@query("assigned_cases", f"""
WITH {SQL_CASES},
people AS (SELECT u AS person, u % 5 AS tenant_id, CASE WHEN u % 2 = 0 THEN 'senior_reviewer' ELSE 'compliance_analyst' END AS role FROM (SELECT unnest(range(20)) AS u)),
ld AS (SELECT tenant_id, assignee_id, count(*) AS n FROM cases WHERE assignee_id IS NOT NULL GROUP BY 1, 2),
seats AS (SELECT p.*, row_number() OVER (PARTITION BY p.tenant_id, role ORDER BY coalesce(n, 0), person) - 1 AS seat, count(*) OVER (PARTITION BY p.tenant_id, role) AS seats FROM people p LEFT JOIN ld ON ld.tenant_id = p.tenant_id AND assignee_id = person),
waiting AS (SELECT case_id, tenant_id, CASE WHEN tier = 'high_risk' THEN 'senior_reviewer' ELSE 'compliance_analyst' END AS role FROM cases WHERE assignee_id IS NULL),
turns AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, role ORDER BY case_id) - 1 AS turn FROM waiting),
dealt AS (SELECT case_id, person FROM turns t JOIN seats s ON s.tenant_id = t.tenant_id AND s.role = t.role AND t.turn % s.seats = s.seat)
SELECT c.case_id, coalesce(assignee_id, person) AS assignee_id FROM cases c LEFT JOIN dealt USING (case_id)""")
def assigned_cases(spark, d):
    u = F.col("id")
    people = spark.range(20).select((u % 5).alias("tenant_id"), u.alias("user_id"), F.when(u % 2 == 0, "senior_reviewer").otherwise("compliance_analyst").alias("role"), F.lit(True).alias("active"))
    return cases.assign(work(spark, d), people).select("case_id", "assignee_id")


@query("decided_cases", f"""
WITH {SQL_CASES},
f AS (SELECT case_id, CASE WHEN case_id % 2 = 0 THEN 'reject' ELSE 'approve' END AS decision, case_id % 20 AS actor FROM cases WHERE case_id % 7 <> 0),
s AS (SELECT case_id, case_id % 4 AS actor FROM cases WHERE case_id % 4 < 2),
j AS (SELECT c.*, f.decision AS fd, f.actor AS fa, s.actor AS sa, f.case_id IS NOT NULL AND (assignee_id IS NULL OR f.actor = assignee_id) AS taken, f.case_id IS NOT NULL AND assignee_id IS NOT NULL AND f.actor <> assignee_id AS wrong
  FROM cases c LEFT JOIN f USING (case_id) LEFT JOIN s USING (case_id)),
k AS (SELECT *, coalesce(tier = 'high_risk' AND taken AND fd = 'reject', false) AS dual, CASE WHEN taken THEN fa END AS person FROM j)
SELECT case_id, CASE WHEN dual AND sa IS NOT NULL AND person IS NOT NULL AND sa <> person THEN 'REJECTED' WHEN taken AND NOT dual THEN CASE fd WHEN 'reject' THEN 'REJECTED' ELSE 'APPROVED' END ELSE state END AS state,
  CASE WHEN taken THEN fd END AS decision, CASE WHEN wrong THEN 'not the assignee' WHEN sa IS NOT NULL AND person IS NULL THEN 'no first approval' WHEN sa IS NOT NULL AND dual AND sa = person THEN 'same person twice' END AS error FROM k""")
def decided_cases(spark, d):
    c = work(spark, d)
    k = F.col("case_id")
    ask = lambda rows, decision, actor, second: rows.select("case_id", decision.alias("decision"), actor.alias("actor_id"), F.lit(second).alias("second"), F.lit(1).alias("at"))
    first = ask(c.where("case_id % 7 <> 0"), F.when(k % 2 == 0, "reject").otherwise("approve"), k % 20, False)
    second = ask(c.where("case_id % 4 < 2"), F.lit("reject"), k % 4, True)
    return cases.decide(c, first.unionByName(second)).select("case_id", "state", "decision", "error")


@query("cleared_hits", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 20 AND l_linestatus = 'O' THEN 'false_positive' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'true_match' END AS disposition,
  CASE WHEN l_quantity < 20 AND l_linestatus = 'O' THEN 'insufficient_evidence' END AS reason FROM lineitem""")
def cleared_hits(spark, d):
    hits = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("score"), F.when(F.col("l_linestatus") == "O", "pending").otherwise("true_match").alias("disposition"), F.lit(None).cast("string").alias("reason"))
    return cases.bulk_clear(hits, 20.0).select("l_orderkey", "l_linenumber", "disposition", "reason")


@query("rescreen_cases", """
SELECT o_custkey AS customer_id, 'review' AS tier FROM orders GROUP BY 1 HAVING max(o_totalprice / 5000) > 72 AND count(*) FILTER (o_orderstatus = 'P') = 0""")
def rescreen_cases(spark, d):
    o = table(spark, d, "orders")
    scores = o.select(F.col("o_custkey").alias("customer_id"), (F.col("o_totalprice") / 5000).alias("score"))
    held = o.select(F.col("o_custkey").alias("customer_id"), F.when(F.col("o_orderstatus") == "P", "PENDING_L1").otherwise("CLEARED").alias("state"))
    return cases.opened_by_rescreen(scores, held)


@query("file_rules", """
SELECT p_partkey, CASE WHEN p_retailprice * 8000 > 10485760 OR p_size % 4 = 3 THEN 'fail' WHEN p_size % 4 <> p_partkey % 3 THEN 'warn' ELSE 'pass' END AS status FROM part""")
def file_rules(spark, d):
    kinds = F.array(*map(F.lit, (*papers.ALLOWED_TYPES, "text/html")))
    return table(spark, d, "part").select("p_partkey", papers.file_rule(F.col("p_retailprice") * 8000, F.get(kinds, F.col("p_size") % 4), F.get(kinds, (F.col("p_partkey") % 3).cast("int"))).alias("status"))
