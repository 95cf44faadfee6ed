"""State changes, reloads and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import papers
from tessera.operators import cases
from tessera.operators import changes as C
from tessera.operators import decisions as D
from tessera.operators import history as H
from tessera.session import table
from tessera.sources import ledger as L

from .registry import query

STATES = ("DRAFT", "SUBMITTED", "PENDING_L1", "PENDING_L2", "ESCALATED")
TARGETS = ("SUBMITTED", "CLEARED", "PENDING_L2", "APPROVED", "DOCS_PROCESSING")
DAY = "yyyy-MM-dd"


def cased(column, values):
    return f"CASE {column} % 5 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def picked(column, values):
    return F.get(F.array(*map(F.lit, values)), (F.col(column) % 5).cast("int"))


SQL_MOVED = f"""
edges(before, after) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, to in H.EDGES.items() for b in to)}),
asked AS (SELECT l_orderkey AS application_id, {cased("l_linenumber", TARGETS)} AS to_state, l_suppkey AS actor_id, l_shipdate AS moment FROM lineitem WHERE l_returnflag = 'R'),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY moment DESC, actor_id DESC, to_state DESC) AS k FROM asked) WHERE k = 1),
old AS (SELECT o_orderkey AS application_id, {cased("o_orderkey", STATES)} AS state, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS submitted FROM orders),
moved AS (SELECT o.application_id, o.state AS before, o.submitted, n.to_state, n.actor_id, n.moment, e.after IS NOT NULL AS ok FROM old o LEFT JOIN newest n USING (application_id)
  LEFT JOIN edges e ON e.before = o.state AND e.after = n.to_state)"""


def moved(spark, d):
    """Orders as applications; their returned lines as requests, of which the newest counts."""
    applications = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("application_id"), picked("o_orderkey", STATES).alias("state"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate")).alias("submitted_at"),
        F.lit(None).cast("timestamp_ntz").alias("decided_at"))
    requests = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("application_id"), picked("l_linenumber", TARGETS).alias("to_state"), F.col("l_suppkey").alias("actor_id"), F.col("l_shipdate").alias("at"))
    return cases.move(applications, requests, H.edge_table(spark))


@query("moved_applications", f"""
WITH {SQL_MOVED}
SELECT application_id, before, CASE WHEN ok THEN to_state ELSE before END AS state, strftime(CASE WHEN ok AND before = 'DRAFT' AND to_state = 'SUBMITTED' THEN moment ELSE submitted END, '%Y-%m-%d') AS submitted_at,
  strftime(CASE WHEN ok AND to_state IN ({", ".join(f"'{t}'" for t in cases.TERMINAL)}) THEN moment END, '%Y-%m-%d') AS decided_at, CASE WHEN to_state IS NOT NULL AND NOT ok THEN 'no such transition' END AS error
FROM moved""")
def moved_applications(spark, d):
    day = lambda c: F.date_format(c, DAY).alias(c)
    return moved(spark, d).select("application_id", "before", "state", day("submitted_at"), day("decided_at"), "error")


@query("transition_events", f"""
WITH {SQL_MOVED}
SELECT application_id, 'application_state_change' AS kind, actor_id, strftime(moment, '%Y-%m-%d') AS day, '{{"from":"' || before || '","to":"' || to_state || '"}}' AS details FROM moved WHERE ok""")
def transition_events(spark, d):
    done = moved(spark, d).where("error is null and actor_id is not null")
    events = cases.events_of(done, "application_id", "application_state_change", F.col("actor_id"), F.col("at"), **{"from": F.col("before"), "to": F.col("state")})
    return events.select("application_id", "kind", "actor_id", F.date_format("at", DAY).alias("day"), "details")


@query("append_only_faults", """
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'deleted' ELSE 'updated' END AS fault FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0""")
def append_only_faults(spark, d):
    """The event log against a copy in which some rows are gone and others altered."""
    log = table(spark, d, "events")
    spoilt = log.where("event_id % 97 <> 0").withColumn("event_type", F.when(F.col("event_id") % 89 == 0, "altered").otherwise(F.col("event_type")))
    return C.not_appended(log, spoilt, ["event_id"])


@query("child_reload", """
WITH loaded AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM loaded)
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity + 1 FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey IN (SELECT o_orderkey FROM loaded)""")
def child_reload(spark, d):
    """Lines as children of orders: the open orders' lines are replaced by a new snapshot's."""
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = old.where("l_linenumber <= 3").withColumn("l_quantity", F.col("l_quantity") + 1)
    entries = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.reloaded_children(old, new, entries, ["l_orderkey"])


@query("suggested_actions", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'clear' WHEN 1 THEN 'clear' ELSE 'escalate' END AS action FROM customer""")
def suggested_actions(spark, d):
    proposed = F.when(F.col("c_custkey") % 5 == 0, "approve").when(F.col("c_custkey") % 5 == 1, "clear").when(F.col("c_custkey") % 5 == 2, "reject").when(F.col("c_custkey") % 5 == 3, "rfi")
    return table(spark, d, "customer").select("c_custkey", D.suggested_action(proposed).alias("action"))


@query("country_pairs", """
SELECT n_nationkey, n_nationkey < 18 AS same FROM nation""")
def country_pairs(spark, d):
    """Nation keys below 18 stand for a country's three-letter code and its own name, the others for the next country's."""
    known = papers.iso_countries(spark)
    pairs = spark.createDataFrame([(k, known[k][1], known[k if k < 18 else k + 1][2]) for k in range(25)], "n_nationkey long, code string, name string")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long"))
    return nations.join(pairs, "n_nationkey").select("n_nationkey", papers.same_country(F.col("code"), F.col("name"), known).alias("same"))


SQL_DAY = "CAST(sum(CAST(('0x' || substr(md5(event_id || '|' || {kind}), 1, 12)) AS BIGINT)) AS VARCHAR)"


@query("ledger_states", f"""
WITH old AS (SELECT strftime(ts, '%Y-%m-%d') AS source, {SQL_DAY.format(kind='event_type')} AS digest FROM events WHERE day(ts) % 7 <> 3 GROUP BY 1),
new AS (SELECT strftime(ts, '%Y-%m-%d') AS source, {SQL_DAY.format(kind="CASE WHEN event_id % 97 = 0 AND day(ts) % 2 = 0 THEN 'altered' ELSE event_type END")} AS digest FROM events WHERE day(ts) % 7 <> 5 GROUP BY 1)
SELECT 'load' AS stage, source, CASE WHEN n.digest IS NULL THEN 'gone' WHEN o.digest IS NULL THEN 'new' WHEN n.digest = o.digest THEN 'unchanged' ELSE 'changed' END AS state
FROM old o FULL JOIN new n USING (source)""")
def ledger_states(spark, d):
    """Days of events as a stage's sources, before and after a change: what a run would have to read again."""
    e = table(spark, d, "events").withColumn("source", F.date_format("ts", DAY))
    day, altered = F.dayofmonth("ts"), F.when((F.col("event_id") % 97 == 0) & (F.dayofmonth("ts") % 2 == 0), "altered").otherwise(F.col("event_type"))

    def digests(events, kind):
        return events.groupBy("source").agg(F.sum(L.row_digest(F.col("event_id"), kind)).cast("string").alias("digest")).withColumn("stage", F.lit("load"))

    before = digests(e.where(day % 7 != 3), F.col("event_type")).withColumns({c: F.lit(None).cast("string") for c in ("validator", "output_digest", "output")}).withColumn("run", F.lit(1))
    return L.states(before, digests(e.where(day % 7 != 5), altered))
