"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source gets a target of words, its weight's share of all words, at most `max_epochs` times what it has;
what a source can't take is shared again by weight. Documents of a source stand in a fixed shuffled order (MD5
of the id). The e-th copy of a document finishes, in virtual time, at

    (e * words of the source + words of the source up to and with the document) / target of the source

and the mix is all copies in order of finish time until the budget, all words, is used up. No source can pass its
target before time 1, so every copy that finishes by then is inside; only the copies just after 1 are range-sorted
and cut where the running sum reaches what is left of the budget.

Defined cases: null or empty text has size 0 and takes 0; a null source is a source of its own, last in order;
null ids and repeated rows are rows like any other; an empty table gives an empty result; other columns of the
input play no part. Rows of one source never meet in one task: they are dealt over hash buckets whose sums are
added up in a table of sources x buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, shuffle_width, stored

ROWS_A_BUCKET = 20_000
#: The name of a row's own number, where documents carry one.
ROW = "__row"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(rid, doc_id, source, src, h, size): src orders sources by code point with null last; h is the shuffled order.

    rid is docs' own column ROW where it has one."""
    return docs.select(
        (F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()).alias("rid"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("1"), F.col(source_col)), F.lit("2")).alias("src"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(sums: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """From (src, size), one row per source: src, source_size, total, target.

    The rule "stop at the cap, share the excess again by weight" ends at one water level: sources in order of
    cap / weight are capped as long as the level that is left for the others lies above their own ratio.
    """
    by = W.orderBy("src")
    cap = F.col("source_size") * max_epochs
    all_rows = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy((cap / F.col("w")).asc(), "src").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sums.groupBy("src").agg(F.sum("size").alias("source_size"))
        .withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by) - 1) % len(weights) + 1).cast("long"))
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("left_w").cast("double"))
        .withColumn("capped", F.col("level") * F.col("w") > cap)
    )
    level = F.min(F.when(~F.col("capped"), F.struct(cap / F.col("w"), "src", "level"))).over(all_rows)["level"]
    return ranked.withColumn("lambda", level).select(
        "src", "source_size", "total",
        F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("lambda") * F.col("w")).alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """Rows (rid, doc_id, source, size, source_size, target, copies, taken), one per row of docs."""
    spark = docs.sparkSession
    sized = stored(word_counts(docs), "mix-sizes")
    buckets = max(16, min(65536, -(-sized.count() // rows_a_bucket)))
    salted = sized.withColumn("bucket", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int"))
    sums = salted.groupBy("src", "bucket").agg(F.sum("size").alias("size"))
    offsets = sums.select(
        "src", "bucket",
        F.coalesce(F.sum("size").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    targets = stored(source_targets(sums, weights, max_epochs).join(offsets, "src"), "mix-targets")
    run = W.partitionBy("src", "bucket").orderBy("h", "doc_id", "size", "rid").rowsBetween(W.unboundedPreceding, 0)
    cum = F.col("offset") + F.col("run")
    copy = lambda e: (e * F.col("source_size") + cum).cast("double") / F.col("target")
    queued = (
        salted.withColumn("run", F.sum("size").over(run)).join(targets, ["src", "bucket"])
        .select("rid", "doc_id", "source", "src", "h", "size", "source_size", "total", "target",
                *[F.when(F.col("size") > 0, copy(e)).alias(f"f{e}") for e in range(max_epochs)])
    )
    queued = stored(queued, "mix-queue")
    finish = [F.col(f"f{e}") for e in range(max_epochs)]
    sure = sum((F.coalesce((f <= 1).cast("int"), F.lit(0)) for f in finish), F.lit(0))
    copies = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), f.alias("finish")) for e, f in enumerate(finish)]))
    late = queued.select("rid", "doc_id", "src", "h", "size", copies.alias("c")).where("c.finish > 1").select("*", "c.*").drop("c")
    state = queued.agg(F.sum(sure * F.col("size")).alias("used"), F.max("total").alias("total")).first()
    last = late.groupBy("src").agg(F.min("finish").alias("f")).agg(F.max("f")).first()[0]
    result = queued.withColumn("sure", sure)
    if last is None:  # nothing stands after time 1
        return result.select("rid", "doc_id", "source", "size", "source_size", "target", F.col("sure").alias("copies"), (F.col("sure") * F.col("size")).alias("taken"))
    order = ["finish", "src", "epoch", "h", "doc_id", "rid"]
    border = stored(
        late.where(F.col("finish") <= F.lit(last)).repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()),
        "mix-border",
    )
    parts = border.groupBy("part").agg(F.sum("size").alias("n"))
    ahead = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = (
        border.withColumn("run", F.sum("size").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
        .join(ahead, "part").where(F.col("ahead") + F.col("run") <= F.lit(state["total"] - state["used"]))
        .groupBy("rid").agg(F.count(F.lit(1)).alias("more"))
    )
    n = F.col("sure") + F.coalesce(F.col("more"), F.lit(0))
    return result.join(inside, "rid", "left").select(
        "rid", "doc_id", "source", "size", "source_size", "target", n.cast("int").alias("copies"), (n * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """docs, columns as they are, each row as often as the mix takes it; rows are told apart by a number of their own, never by what they hold."""
    numbered = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "mix-rows")
    n = mix(numbered, weights, max_epochs).where("copies > 0").select(F.col("rid").alias(ROW), F.col("copies").alias("__copies"))
    return numbered.join(n, ROW).withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


#: The same mix as one plain query, over windows without any dealing out.
SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS src, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY src),
ranked AS (SELECT src, source_size, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / CAST(w AS DOUBLE), src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_n,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / CAST(w AS DOUBLE), src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w
  FROM ranked),
levels AS (SELECT *, CAST(left_n AS DOUBLE) / CAST(left_w AS DOUBLE) AS level FROM filled),
lam AS (SELECT arg_min(level, struct_pack(a := cap / CAST(w AS DOUBLE), b := src)) AS l FROM levels WHERE level * w <= cap),
targets AS (SELECT src, source_size, total, CASE WHEN level * w > cap THEN CAST(cap AS DOUBLE) ELSE l * w END AS target FROM levels, lam),
queued AS (
  SELECT s.doc_id, s.src, s.h, s.size, t.source_size, t.total, t.target,
    sum(s.size) OVER (PARTITION BY s.src ORDER BY s.h, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS cum,
    row_number() OVER (ORDER BY s.src, s.h, s.doc_id, s.size) AS rid
  FROM sized s JOIN targets t USING (src)),
copies AS (
  SELECT q.*, e.epoch, CAST(e.epoch * source_size + cum AS DOUBLE) / target AS finish
  FROM queued q, (SELECT unnest([0, 1, 2]) AS epoch) e WHERE size > 0),
cut AS (SELECT rid, size, total, sum(size) OVER (ORDER BY finish, src, epoch, h, doc_id, rid ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
kept AS (SELECT rid, sum(size) AS n FROM cut WHERE upto <= total GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(n, 0) AS BIGINT) AS taken FROM queued LEFT JOIN kept USING (rid)
"""
