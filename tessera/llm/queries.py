"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, chat_format, exact_dedup, jaccard_join, line_dedup, mixing, packing, page_text, quality, secret_scan, token_counts, vector_dedup, whitening
from .common import table


def op10_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark, sf_dir):
    return secret_scan.scan_with_own_model(table(spark, sf_dir, "documents"))


def op4_near_vectors(spark, sf_dir):
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_page_text(spark, sf_dir):
    return page_text.extract(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("text", 256).alias("text_sha256"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.similar(table(spark, sf_dir, "documents"), count_links=True)


def op1_chat_format(spark, sf_dir):
    return chat_format.formatted(table(spark, sf_dir, "conversations"))


def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir):
    out = alignment.align(table(spark, sf_dir, "documents"))
    return out.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")


def queries():
    return {
        "op11_whitening": op11_whitening,
        "op12_token_counts": op12_token_counts,
        "op13_token_alignment": op13_token_alignment,
        "op1_chat_format": op1_chat_format,
        "op5_jaccard_join": op5_jaccard_join,
        "op8_line_dedup": op8_line_dedup,
        "op9_page_text": op9_page_text,
        "op4_near_vectors": op4_near_vectors,
        "op3_secret_scan": op3_secret_scan,
        "op7_quality": op7_quality,
        "op6_pack": op6_pack,
        "op2_exact_dedup": op2_exact_dedup,
        "op10_mix_sources": op10_mix_sources,
    }


def oracle_sql():
    return {
        "op1_chat_format": chat_format.SQL,
        "op2_exact_dedup": exact_dedup.SQL,
        "op10_mix_sources": mixing.SQL,
    }
