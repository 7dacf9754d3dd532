"""The numbered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.llm.bpe import bpe_digests
from snaplake.llm.common import table
from snaplake.llm.decontaminate import contained_items
from snaplake.llm.divergence import source_divergence
from snaplake.llm.embeddings import near_vectors
from snaplake.llm.htmltext import main_text
from snaplake.llm.linededup import line_dedup
from snaplake.llm.negatives import hard_negatives
from snaplake.llm.quality import fit, quality_scores
from snaplake.llm.sharding import shard_by_bytes
from snaplake.llm.simhash import simhash_groups
from snaplake.llm.spans import span_dedup
from snaplake.llm.topk import top_products
from snaplake.llm.warc import archived

#: Shards of op10.
SHARDS = 40


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (positions), text_md5 (of the text that is left; null texts: null)."""
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: a row for each benchmark item that a document holds."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed, text (what is left)."""
    return span_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict:
    every = (op1_line_dedup, op2_decontamination, op3_embedding_links, op4_simhash, op5_warc, op6_substring_dedup, op7_quality, op8_html_extraction, op9_bpe, op10_sharding, op11_hard_negatives, op12_top_k, op13_source_divergence)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from snaplake.llm.sql import ORACLES

    return dict(ORACLES)
