"""A corpus pipeline of five stages, each of which calls one of the numbered operators on all rows it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.llm.bpe import bpe_encode
from snaplake.llm.common import durable, free_names, table
from snaplake.llm.decontaminate import decontaminate
from snaplake.llm.linededup import line_dedup
from snaplake.llm.quality import fit, quality_filter
from snaplake.llm.queries import vocabulary_path
from snaplake.llm.simhash import simhash_dedup

#: SQL for run()'s rows: the classifier and the edit join can't be written in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on docs' labelled rows, accepts. No labels: all documents."""
    return quality_filter(docs, fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; documents of which nothing but blanks is left go, n_chars follows the text."""
    (was,) = free_names(docs, "was_blank")
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "") == ""
    cut = line_dedup(docs.withColumn(was, blank))
    left = cut.where(F.col(was) | ~blank)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast("long"))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, four fifths of them shared)."""
    return simhash_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers)."""
    encoded = bpe_encode(docs.select("doc_id", "text"), vocabulary_path())
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage keeps is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
