"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last keep the columns of documents, and rows are told apart as rows: nulls in any column,
repeated ids and extra columns of any name, but for those that begin with two underscores, pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard_join, mixing, packing, quality
from tessera.llm.common import stored, table

#: Near duplicates of the pipeline: word shingles of five words, similarity of 0.8 or more.
SHINGLE, SIMILAR = 5, (80, 100)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are scored alike, repeated rows each."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name="__score").where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null as empty, the document with the largest id stays, one row of it."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest id, of rows with one id the first; a null id
    stays only where the whole group has none. Documents without words have no near duplicate and stay."""
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    found = jaccard_join.similar(rows, id_col="__row", width=SHINGLE, num=SIMILAR[0], den=SIMILAR[1])
    grouped = found.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group")).join(rows.select("__row", F.col("doc_id").alias("__id")), "__row")
    first = F.min(F.struct(F.col("__id").isNull().alias("nameless"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    kept = grouped.groupBy("__group").agg(first.alias("first")).select(F.col("first.row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once, or up to three times; a row without words is never taken."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; each row is a document of its own, whatever its id."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
