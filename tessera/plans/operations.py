"""Operational queries: volumes, funnels, queues, service levels, quality, histories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import analytics as A
from tessera.operators import decisions as D
from tessera.operators import history as H
from tessera.session import table

from .registry import query

DAY = "yyyy-MM-dd"
SQL_K = "CAST(props->>'$.k' AS INTEGER)"


def number():
    return F.get_json_object("props", "$.k").cast("int")


def as_of(df, ts="ts"):
    """The data's last moment, joined as one row; there is no clock in a query."""
    return df.crossJoin(F.broadcast(df.agg(F.max(ts).alias("as_of"))))


@query("daily_volume", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY GROUP BY 1""")
def daily_volume(spark, d):
    return A.daily_volume(as_of(table(spark, d, "events")), "ts", F.col("as_of")).select(F.date_format("day", DAY).alias("day"), "n")


@query("funnel_distinct", """
SELECT count(DISTINCT user_id) FILTER (event_type = 'signup') AS submitted, count(DISTINCT user_id) FILTER (event_type IN ('view', 'click')) AS screened,
  count(DISTINCT user_id) FILTER (event_type = 'click') AS decided, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS approved FROM events""")
def funnel_distinct(spark, d):
    return A.funnel(table(spark, d, "events"), F.col("event_type"), "user_id", {"submitted": ["signup"], "screened": ["view", "click"], "decided": ["click"], "approved": ["purchase"]})


@query("tier_distribution", "SELECT o_orderpriority AS tier, count(*) AS n FROM orders GROUP BY 1")
def tier_distribution(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("sla_compliance", """
SELECT count(*) FILTER (due < as_of) AS breached, count(*) FILTER (due >= as_of) AS on_track FROM (
  SELECT o_orderdate + to_days(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS due, (SELECT max(o_orderdate) FROM orders) - INTERVAL 200 DAY AS as_of
  FROM orders WHERE o_orderstatus IN ('O', 'P'))""")
def sla_compliance(spark, d):
    o = as_of(table(spark, d, "orders"), "o_orderdate")
    due = F.col("o_orderdate") + F.make_interval(days=F.substring("o_orderpriority", 1, 1).cast("int"))
    return A.sla(o, F.col("o_orderstatus").isin("O", "P"), due, F.col("as_of") - F.expr("INTERVAL 200 DAYS"))


@query("usage_by_provider", f"""
WITH g AS (SELECT event_type AS provider, CASE {SQL_K} % 3 WHEN 0 THEN 'cached' WHEN 1 THEN 'ok' ELSE 'error' END AS status, count(*) AS calls, CAST(coalesce(sum({SQL_K}), 0) AS BIGINT) AS tokens FROM events GROUP BY 1, 2)
SELECT *, round(CAST(sum(CASE WHEN status = 'cached' THEN calls ELSE 0 END) OVER () AS DOUBLE) / CAST(sum(calls) OVER () AS DOUBLE), 4) AS cache_rate FROM g""")
def usage_by_provider(spark, d):
    status = F.when(number() % 3 == 0, "cached").when(number() % 3 == 1, "ok").otherwise("error")
    return A.usage(table(spark, d, "events"), F.col("event_type"), status, number())


@query("usage_pivot", """
SELECT event_type, count(*) FILTER (dow = 0) AS sun, count(*) FILTER (dow = 1) AS mon, count(*) FILTER (dow = 2) AS tue, count(*) FILTER (dow = 3) AS wed,
  count(*) FILTER (dow = 4) AS thu, count(*) FILTER (dow = 5) AS fri, count(*) FILTER (dow = 6) AS sat FROM (SELECT event_type, dayofweek(ts) AS dow FROM events) GROUP BY 1""")
def usage_pivot(spark, d):
    names = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
    day = F.get(F.array(*map(F.lit, names)), F.dayofweek("ts") - 1)
    return A.pivoted(table(spark, d, "events"), "event_type", day, names, F.count(F.lit(1)))


@query("json_predicate", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE props->>'$.k' IN ('1', '3', '5') GROUP BY 1")
def json_predicate(spark, d):
    e = table(spark, d, "events").where(F.get_json_object("props", "$.k").isin("1", "3", "5"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("case_queue_page", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%'
ORDER BY o_totalprice DESC, o_orderkey OFFSET 50 LIMIT 50""")
def case_queue_page(spark, d):
    """A page of the queue; the limit is what a page is."""
    page = A.paged(table(spark, d, "orders"), [F.col("o_orderstatus") == "O", None, F.col("o_orderpriority").startswith("1")], [F.desc("o_totalprice"), F.asc("o_orderkey")], 50, 50)
    return page.select("o_orderkey", "o_custkey", "o_totalprice")


@query("case_queue_seek", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey OFFSET 100 LIMIT 50""")
def case_queue_seek(spark, d):
    """The third page of the queue, each page sought after the last row of the one before it; the limit is what a page is."""
    queue, order = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)]
    last = None
    for _ in range(2):
        last = (A.seek(queue, order, last, 50).tail(1) or [last])[0]
    return A.seek(queue, order, last.asDict() if last else None, 50)


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return A.latest_per_key(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("topk_per_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def topk_per_group(spark, d):
    """The three largest orders of each customer."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return A.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("least_loaded", """
WITH l AS (SELECT s_nationkey, s_suppkey, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON l_suppkey = s_suppkey)
SELECT s_nationkey, s_suppkey, n AS open_cases FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY n, s_suppkey) AS r FROM l) WHERE r = 1""")
def least_loaded(spark, d):
    load = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("s_suppkey"))
    return A.least_loaded(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), load, "s_suppkey", "s_nationkey")


@query("permission_semi", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))")
def permission_semi(spark, d):
    granted = table(spark, d, "nation").join(table(spark, d, "region").where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(granted, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_name")


@query("removed_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def removed_anti(spark, d):
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(seen, "p_partkey", "left_anti")


@query("attr_gather", """
SELECT c_custkey, coalesce(orders, '') AS orders, coalesce(statuses, '') AS statuses FROM customer LEFT JOIN (
  SELECT o_custkey, array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR))), ',') AS orders, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS statuses FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def attr_gather(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("k"), F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    joined = table(spark, d, "customer").select("c_custkey").join(lists, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce(F.array_join("k", ","), F.lit("")).alias("orders"), F.coalesce(F.array_join("s", ","), F.lit("")).alias("statuses"))


@query("worst_of", """
SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS worst FROM orders GROUP BY 1""")
def worst_of(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "fail").when(F.col("o_orderstatus") == "O", "warn").otherwise("pass")
    return A.worst_of(table(spark, d, "orders"), "o_custkey", status)


@query("freshness", "SELECT CAST(epoch((SELECT max(o_orderdate) FROM orders)) - epoch(max(ts)) AS BIGINT) AS seconds FROM events")
def freshness(spark, d):
    last = table(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of"))
    seen = table(spark, d, "events").agg(F.max("ts").alias("ts"))
    return A.freshness(seen.crossJoin(last).groupBy("as_of").agg(F.max("ts").alias("ts")), "ts", F.max("as_of"))


@query("latency_histogram", """
SELECT CAST(le AS DOUBLE) AS le, count(*) FILTER (value / 100 <= le) AS n FROM events, (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 1, 2, 5, 10]::DOUBLE[]) AS le) GROUP BY le""")
def latency_histogram(spark, d):
    return A.histogram(table(spark, d, "events"), F.col("value") / 100)



QUANTILES = (0.5, 0.95, 0.99)


@query("latency_quantiles", """
WITH h AS (SELECT le, count(*) FILTER (value / 100 <= le) AS n FROM events, (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5, 1, 2, 5, 10, 'inf'::DOUBLE]::DOUBLE[]) AS le) GROUP BY le),
e AS (SELECT le, n, coalesce(lag(le) OVER (ORDER BY le), 0) AS low, coalesce(lag(n) OVER (ORDER BY le), 0) AS below, max(n) OVER () AS total FROM h)
SELECT q, round(arg_min(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (q * total - below) / (n - below) END, le), 6) AS p
FROM e, (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q) WHERE n >= q * total AND n > below GROUP BY q""")
def latency_quantiles(spark, d):
    """Quantiles as a dashboard reads them off the histogram's buckets."""
    buckets = A.histogram(table(spark, d, "events"), F.col("value") / 100, (*A.LATENCY_BOUNDS, float("inf")))
    each = [A.interpolated_quantile(buckets, q).select(F.lit(q).alias("q"), F.round("p", 6).alias("p")) for q in QUANTILES]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("latency_p95", "SELECT value AS p FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events) WHERE r = floor(n * 0.95)")
def latency_p95(spark, d):
    return A.nearest_rank(table(spark, d, "events"), "value", 0.95)


@query("dq_checks", """
SELECT count(*) AS n, count(*) - count(DISTINCT p_name) AS duplicates, count(*) FILTER (trim(coalesce(p_name, '')) = '') AS blank,
  count(*) BETWEEN (SELECT count(*) FROM part) * 0.9 AND (SELECT count(*) FROM part) * 1.1 AS within_tolerance, count(*) >= 100 AS above_floor FROM part WHERE p_partkey % 17 <> 3""")
def dq_checks(spark, d):
    p = table(spark, d, "part")
    new = p.where("p_partkey % 17 <> 3").crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("before"))))
    return A.quality_checks(new, "p_name", "p_name", F.max("before"), 100)


@query("error_rate", """
SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, round(CAST(count(*) FILTER (value > 100) AS DOUBLE) / count(*), 6) AS rate FROM events GROUP BY 1, 2""")
def error_rate(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"))
    return e.agg(F.round(F.count_if(F.col("value") > 100) / F.count(F.lit(1)), 6).alias("rate"))


SQL_EDGES = "(SELECT unnest(['view', 'view', 'click', 'click', 'signup', 'purchase', 'error']) AS a, unnest(['click', 'view', 'purchase', 'view', 'view', 'view', 'view']) AS b)"
EDGES = {"view": ("click", "view"), "click": ("purchase", "view"), "signup": ("view",), "purchase": ("view",), "error": ("view",)}


@query("state_transitions", f"""
WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, before, event_type FROM s WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {SQL_EDGES} WHERE a = before AND b = event_type)""")
def state_transitions(spark, d):
    bad = H.bad_transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", H.edge_table(spark, EDGES))
    return bad.select("user_id", "event_id", "before", "event_type")


@query("chain_verify", """
SELECT user_id, count(*) AS rows, min(event_id) FILTER (event_id % 101 = 7 OR event_id % 307 = 5) AS first_broken FROM events GROUP BY 1""")
def chain_verify(spark, d):
    """A log chained row by row, then spoilt by rule in its contents or its links: the first spoilt row of each chain must be found."""
    body = F.concat_ws("|", "event_type", F.col("event_id").cast("string"), F.col("value").cast("string"))
    log = H.append_chained(spark, table(spark, d, "events").select("user_id", "event_id", body.alias("body")), "user_id", "event_id", "body")
    spoilt = log.withColumns({
        "body": F.when(F.col("event_id") % 101 == 7, F.concat("body", F.lit("!"))).otherwise(F.col("body")),
        "prev_hash": F.when(F.col("event_id") % 307 == 5, F.sha2("hash", 256)).otherwise(F.col("prev_hash")),
    })
    return H.chain_faults(spoilt, "user_id", "event_id", F.col("body"))


@query("lockout_runs", """
WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS k FROM r WHERE event_type = 'error')
SELECT user_id, event_id, CAST(k AS INTEGER) AS run_length, CAST(CASE WHEN k >= 5 THEN 30 * pow(2, k - 5) ELSE 0 END AS BIGINT) AS lock_seconds FROM n""")
def lockout_runs(spark, d):
    return H.failure_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "run_length", "lock_seconds")


@query("token_family_reuse", f"""
SELECT user_id, count(*) AS tokens, max(uses) > 1 AS revoked FROM (SELECT user_id, {SQL_K} AS k, count(*) AS uses FROM events GROUP BY 1, 2) GROUP BY 1""")
def token_family_reuse(spark, d):
    return H.reused_families(table(spark, d, "events").withColumn("k", number()), "user_id", "k", "ts")


@query("quota_minute", f"SELECT event_type, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS requests, CAST(sum({SQL_K}) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def quota_minute(spark, d):
    used = H.bucketed_usage(table(spark, d, "events"), "event_type", "ts", number(), "1 minute")
    return used.select("event_type", F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "requests", "tokens")


@query("quota_headroom", f"""
WITH m AS (SELECT event_type, max(requests) AS rpm, max(tokens) AS tpm FROM (SELECT event_type, date_trunc('minute', ts) AS b, count(*) AS requests, sum({SQL_K}) AS tokens FROM events GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT event_type, max(requests) AS rpd FROM (SELECT event_type, date_trunc('day', ts) AS b, count(*) AS requests FROM events GROUP BY 1, 2) GROUP BY 1)
SELECT event_type, rpm, CAST(tpm AS BIGINT) AS tpm, rpd, rpm < 30 AND rpd < 14400 AND tpm < 6000 AS headroom FROM m JOIN d USING (event_type)""")
def quota_headroom(spark, d):
    e = table(spark, d, "events")
    minute = H.bucketed_usage(e, "event_type", "ts", number(), "1 minute").groupBy("event_type").agg(F.max("requests").alias("rpm"), F.max("tokens").alias("tpm"))
    day = H.bucketed_usage(e, "event_type", "ts", number(), "1 day").groupBy("event_type").agg(F.max("requests").alias("rpd"))
    return minute.join(day, "event_type").withColumn("headroom", (F.col("rpm") < 30) & (F.col("rpd") < 14400) & (F.col("tpm") < 6000)).select("event_type", "rpm", "tpm", "rpd", "headroom")


@query("circuit_sessions", """
WITH s AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
f AS (SELECT *, CASE WHEN epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id, run ORDER BY ts, event_id))::BIGINT > 60 THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM s WHERE event_type = 'error'),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS grp FROM f)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since, count(*) AS failures, count(*) >= 5 AS opened FROM g GROUP BY user_id, run, grp""")
def circuit_sessions(spark, d):
    out = H.breaker_openings(table(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", F.col("event_type") == "error")
    return out.select("user_id", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "failures", "opened")


@query("dedupe_idempotent", f"SELECT user_id, k, event_id FROM (SELECT user_id, {SQL_K} AS k, event_id, row_number() OVER (PARTITION BY user_id, {SQL_K} ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedupe_idempotent(spark, d):
    return H.first_per_key(table(spark, d, "events").select("user_id", number().alias("k"), "ts", "event_id"), ["user_id", "k"], ["ts", "event_id"]).select("user_id", "k", "event_id")


@query("rate_limited", "SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limited(spark, d):
    used = H.bucketed_usage(table(spark, d, "events"), "user_id", "ts", F.lit(0), "1 minute").where("requests > 1")
    return used.select("user_id", F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "requests")


@query("grouped_details", """
SELECT o_orderkey, array_to_string(list_sort(list(lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':' || l_returnflag)), ',') AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1""")
def grouped_details(spark, d):
    """A case with its events, as one sorted list."""
    joined = table(spark, d, "orders").where("o_orderstatus = 'P'").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.concat_ws(":", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), "l_returnflag")
    return joined.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("lines"))


@query("confusion_sweep", """
WITH r AS (SELECT l.quality = 1 AS pos, d.doc_id % 7 <> 0 AS hit, CAST(d.n_chars % 101 AS DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id)),
t AS (SELECT unnest([50, 55, 60, 65, 70, 72, 75, 80, 85, 89, 90, 95]::DOUBLE[]) AS threshold),
m AS (SELECT threshold, count(*) FILTER (pos AND score >= threshold AND hit) AS tp, count(*) FILTER (NOT pos AND score >= threshold) AS fp,
  count(*) FILTER (pos AND NOT (score >= threshold AND hit)) AS fn, count(*) FILTER (NOT pos AND score < threshold) AS tn FROM r, t GROUP BY 1),
q AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision FROM m)
SELECT threshold, tp, fp, fn, tn, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1,
  round(CASE WHEN fp + tn > 0 THEN fp / CAST(fp + tn AS DOUBLE) ELSE 0 END, 6) AS fpr FROM q""")
def confusion_sweep(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    r = r.select(F.when(F.col("quality") == 1, "true_match").otherwise("clean").alias("label"), F.col("doc_id").alias("true_entity"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("top_entity"), (F.col("n_chars") % 101).cast("double").alias("top_score"))
    m = D.confusion(r, D.thresholds_sweep())
    return m.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1", "fpr")])
