"""Logic over event histories: transitions, hash chains, lockouts, token families, quotas, breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.storage import written

# The application's states and where each may lead.
EDGES = {
    "DRAFT": ("SUBMITTED",), "SUBMITTED": ("DOCS_PROCESSING", "RFI_REQUESTED"), "DOCS_PROCESSING": ("DOCS_VERIFIED", "DOCS_FAILED"), "DOCS_VERIFIED": ("SCREENING",),
    "SCREENING": ("AUTO_APPROVED", "PENDING_L1", "PENDING_L2", "SYSTEM_REJECTED"), "PENDING_L1": ("CLEARED", "ESCALATED", "RFI_REQUESTED"),
    "PENDING_L2": ("APPROVED", "REJECTED", "RFI_REQUESTED"), "ESCALATED": ("PENDING_L2",), "RFI_REQUESTED": ("SUBMITTED",),
}
GENESIS = "0" * 64
LOCK_AFTER, LOCK_SECONDS = 5, 30
BREAK_AFTER, BREAK_SECONDS = 5, 60


def edge_table(spark: SparkSession, edges: dict = EDGES) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in edges.items() for b in to], "before string, after string")


def bad_transitions(events: DataFrame, key: str, order: list[str], state: str, edges: DataFrame) -> DataFrame:
    """Events whose step from the state before is no edge; a subject's first event is always allowed."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(*order))
    steps = events.withColumn("before", before).where("before is not null")
    return steps.join(edges.select(F.col("before"), F.col("after").alias(state)), ["before", state], "left_anti")


def chain_links(log: DataFrame, tenant: str, order: str, payload: Column, ranges: int | None = None) -> DataFrame:
    """Each row with its range of the log and whether its own hash holds: a large tenant's chain is many ranges, each a task's."""
    own = F.col("hash").eqNullSafe(F.sha2(F.concat("prev_hash", payload), 256))
    rows = log.select(tenant, order, "prev_hash", "hash", own.alias("own"))
    by = [F.col(tenant), F.col(order)]
    dealt = rows.repartitionByRange(*by) if ranges is None else rows.repartitionByRange(ranges, *by)
    return written(dealt.withColumn("range", F.spark_partition_id()), "chain")  # written, so that a range is the same wherever it is read


def chain_heads(log: DataFrame, tenant: str, order: str) -> DataFrame:
    """The last place and hash of each tenant's chain, from which a later verification goes on."""
    return log.groupBy(tenant).agg(F.max(order).alias("upto"), F.max_by("hash", order).alias("head"))


def chain_faults(log: DataFrame, tenant: str, order: str, payload: Column, since: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Per tenant (a null tenant is its own) the first id whose prev_hash or hash doesn't hold.

    Ranges of the log are verified side by side; the last hash of each is handed to the tenant's next one. With since,
    chain_heads() of what was verified before, only later rows are looked at, and counted.
    """
    if since is not None:
        known = since.select(F.col(tenant).alias("__tenant"), "upto", "head")
        log = log.join(known, F.col(tenant).eqNullSafe(F.col("__tenant")), "left").where(F.col("upto").isNull() | (F.col(order) > F.col("upto"))).drop("__tenant", "upto", "head")
    links = chain_links(log, tenant, order, payload, ranges)
    ends = links.groupBy(tenant, "range").agg(F.max_by("hash", order).alias("last"))
    seams = ends.select(F.col(tenant).alias("__tenant"), F.col("range").alias("__range"), F.lag("last").over(W.partitionBy(tenant).orderBy("range")).alias("handed"))
    begun = F.coalesce("handed", F.lit(GENESIS))
    if since is not None:
        seams = seams.join(known.withColumnRenamed("__tenant", "__known"), F.col("__tenant").eqNullSafe(F.col("__known")), "left")
        begun = F.coalesce("handed", "head", F.lit(GENESIS))
    seams = seams.select("__tenant", "__range", begun.alias("handed"))
    before = F.lag("hash").over(W.partitionBy("range", tenant).orderBy(order))
    met = links.withColumn("before", before).join(seams, (F.col("range") == F.col("__range")) & F.col(tenant).eqNullSafe(F.col("__tenant")))
    broken = ~F.col("own") | ~F.col("prev_hash").eqNullSafe(F.coalesce("before", "handed"))
    return met.groupBy(tenant).agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(broken, F.col(order))).alias("first_broken"))


def append_chained(spark: SparkSession, log: DataFrame, tenant: str, order: str, payload: str) -> DataFrame:
    """Writes prev_hash and hash; a tenant's chain is sequential, tenants run in parallel. Only the last hash is held, never a tenant's rows."""
    import hashlib

    import pandas as pd

    def run(frames):
        now, previous, begun = None, GENESIS, False
        for pdf in frames:
            prev, cur = [], []
            for owner, text in zip(pdf[tenant], pdf[payload]):
                if not begun or not (owner == now or (pd.isna(owner) and pd.isna(now))):
                    now, previous, begun = owner, GENESIS, True
                prev.append(previous)
                previous = hashlib.sha256((previous + text).encode()).hexdigest()
                cur.append(previous)
            yield pdf.assign(prev_hash=prev, hash=cur)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    return log.repartition(tenant).sortWithinPartitions(tenant, order).mapInPandas(run, f"{fields}, prev_hash string, hash string")


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Adds to each failure its number in the run since the last success, and from the fifth on the lock in seconds."""
    runs = events.withColumn("__f", failed).withColumn("__run", F.sum((~F.col("__f")).cast("int")).over(W.partitionBy(key).orderBy(*order)))
    n = F.row_number().over(W.partitionBy(key, "__run").orderBy(*order))
    seconds = F.when(F.col("run_length") >= LOCK_AFTER, LOCK_SECONDS * F.pow(F.lit(2), F.col("run_length") - LOCK_AFTER)).otherwise(0).cast("long")
    return runs.where("__f").withColumn("run_length", n).withColumn("lock_seconds", seconds).drop("__f", "__run")


def reused_families(tokens: DataFrame, family: str, token: str, used_at: str) -> DataFrame:
    """Families in which a token was used again: all their tokens are revoked."""
    uses = tokens.groupBy(family, token).agg(F.count(F.lit(1)).alias("uses"))
    return uses.groupBy(family).agg(F.count(F.lit(1)).alias("tokens"), (F.max("uses") > 1).alias("revoked"))


def bucketed_usage(calls: DataFrame, provider: str, ts: str, tokens: Column, every: str) -> DataFrame:
    """Requests and tokens of each provider in tumbling buckets."""
    return calls.groupBy(provider, F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("tokens")).select(provider, F.col("w.start").alias("bucket"), "requests", "tokens")


def breaker_openings(calls: DataFrame, provider: str, order: list[str], ts: str, failed: Column) -> DataFrame:
    """Runs of failures that no success and no gap of over a minute parts, in seconds to the nearest; a run of five opens the breaker.

    Batch form over history; the streaming form keeps the counter as state.
    """
    w = W.partitionBy(provider).orderBy(*order)
    success_runs = F.sum((~F.col("__f")).cast("int")).over(w)
    failures = calls.withColumn("__f", failed).withColumn("__s", success_runs).where("__f")
    by_run = W.partitionBy(provider, "__s").orderBy(*order)
    second = lambda c: F.rint(F.unix_micros(c.cast("timestamp")) / 1e6)
    gap = second(F.col(ts)) - second(F.lag(ts).over(by_run))
    new = failures.withColumn("__new", F.coalesce((gap > BREAK_SECONDS).cast("int"), F.lit(1))).withColumn("__g", F.sum("__new").over(by_run))
    return new.groupBy(provider, "__s", "__g").agg(F.count(F.lit(1)).alias("failures"), F.min(ts).alias("since")).drop("__s", "__g").withColumn("opened", F.col("failures") >= BREAK_AFTER)


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Idempotent replay: of rows that share a key the first counts."""
    rest = [c for c in df.columns if c not in key and c not in order]
    return df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("m")).select(*key, "m.*")


def replaced_chain(spark: SparkSession, tokens: DataFrame, start: int) -> DataFrame:
    """The rotation list from one token on, by recursive SQL."""
    tokens.createOrReplaceTempView("__rotation")
    return spark.sql(f"""
        WITH RECURSIVE chain(id, replaced_by_id, depth) AS (
          SELECT id, replaced_by_id, 0 FROM __rotation WHERE id = {int(start)}
          UNION ALL SELECT t.id, t.replaced_by_id, c.depth + 1 FROM chain c JOIN __rotation t ON t.id = c.replaced_by_id)
        SELECT * FROM chain""")
