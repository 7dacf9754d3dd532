"""Ranked search: words (BM25), vectors (cosine), both (reciprocal ranks), recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplake.catalog import durable
from snaplake.operators.filters import _words, tokens

#: Ours: weights of term frequency and document length, and the constant of reciprocal ranks.
K1, B, RRF = 1.2, 0.75, 60


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, last_as_prefix: bool = False) -> DataFrame:
    """(id, score) of documents with at least one of the query's words.

    One pass over the texts counts each document's length and its words that the query has, and is written to
    the shared folder; numbers of documents, lengths and document frequencies are aggregates of it.
    """
    words = list(dict.fromkeys(_words(query)))
    exact, prefix = (words[:-1], words[-1:]) if last_as_prefix else (words, [])
    found = tokens(F.coalesce(F.col(text_col), F.lit("")))
    wanted = lambda w: w.isin(exact) | w.startswith(prefix[0]) if exact and prefix else (w.startswith(prefix[0]) if prefix else w.isin(exact))
    base = durable(docs.select(F.col(id_col).alias("id"), found.alias("w")).select("id", F.size("w").alias("len"), F.filter("w", wanted).alias("hits")))
    stats = base.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"))
    terms = base.select("id", "len", F.explode("hits").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    freq = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    return terms.join(freq, "term").crossJoin(F.broadcast(stats)).groupBy("id").agg(F.round(F.sum(part), 12).alias("score"))  # stats is one row; rounded, so that equal texts tie in whatever order their parts are added


def cosine(c: Column, query: list[float]) -> Column:
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(c, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm * float(sum(x * x for x in query) ** 0.5))


def semantic(rows: DataFrame, id_col: str, vector_col: str, query: list[float]) -> DataFrame:
    return rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), cosine(F.col(vector_col), query).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best, ties by id: each task keeps k."""
    return scores.orderBy(F.desc("score"), "id").limit(k)


def recent(rows: DataFrame, id_col: str, time_col: str, k: int) -> DataFrame:
    """(id, score) of the k ids with the latest times, ties by the larger id; score is the time in seconds. Rows without a time come last."""
    latest = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(time_col).alias("at"))
    return latest.orderBy(F.desc_nulls_last("at"), F.desc("id")).limit(k).select("id", F.col("at").cast("timestamp").cast("double").alias("score"))


def placed(best: DataFrame) -> DataFrame:
    """A few best rows (a top-k result) with their place, from 1."""
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "id")))


def ranked(scores: DataFrame) -> DataFrame:
    """(id, r) with r = 1, 2, ... by descending score, ties by id, for all rows.

    Rows are range-partitioned in that order and numbered within their partition; partitions before it are
    counted, so that no task gets all rows. The sorted rows are written once: both steps see the same partitions.
    """
    order = (F.desc("score"), F.asc("id"))
    rows = scores.select("id", "score")
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = durable(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    counts = sorted((r.part, r.n) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    if not counts:
        return rows.select("id", F.lit(0).cast("long").alias("r"))
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    before = F.broadcast(scores.sparkSession.createDataFrame(starts, "part int, before long"))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return numbered.join(before, "part").select("id", (F.col("before") + F.col("at")).alias("r"))


def hybrid(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(id, score): the k best sums of 1/(60 + rank) over all rows of either."""
    both = ranked(left).unionAll(ranked(right))
    return top(both.groupBy("id").agg(F.sum(1 / (RRF + F.col("r"))).alias("score")), k)
