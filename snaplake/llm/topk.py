"""Exact search for the highest inner products, by statistics of segments from coarse to fine.

Vectors are cut into 1, 4 and 16 segments of equal length n. With the means m and deviations s of segments,
the squared distance of q and x is at least the sum of n * ((mq - mx)**2 + (sq - sx)**2). As the sums of
n * (m**2 + s**2) are the squared norms, and twice the score is the squared norms less the squared distance,
the score is at most the sum of n * (mq * mx + sq * sx): one product of the statistics. Pairs that can't
reach their query's k-th score of the moment are left out level by level; scores of the others are exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm.scored import BLOCK, LEAST_PART, PER_TASK, Best, against, batches_of, exact_in_doubles, integer_vectors, large_products, matrix, same_width

#: Segments of each level; part of the pairs under which scores are taken pair by pair.
LEVELS, SPARSE = (1, 4, 16), 0.05
#: Rows by which a task's first scores are found, before any bound can tell.
FIRST = 128


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, times the root of its length, side by side."""
    cut = vectors.astype(np.float64).reshape(len(vectors), segments, -1)
    return np.concatenate([cut.mean(axis=2), cut.std(axis=2)], axis=1) * np.sqrt(cut.shape[2])


class Search:
    """The k best rows of each asked row."""

    def __init__(self, asked, k: int):
        self.ids, self.vectors = asked.column("id").to_numpy(), matrix(asked.column("v"))
        self.best, self.seen, self.pairs, self.scored = Best(len(self.ids), k), 0, 0, 0

    def add(self, rows) -> None:
        if not self.seen and rows.num_rows > FIRST:
            self.add(rows.slice(0, FIRST))
            rows = rows.slice(FIRST)
        self.seen += rows.num_rows
        ids = rows.column("id").to_numpy()
        asked, there = same_width(self.vectors, matrix(rows.column("v")), max(LEVELS))
        live = self.ids[:, None] != ids[None, :]
        self.pairs += live.size
        if not exact_in_doubles(asked, there):
            at, of = np.nonzero(live)
            self.best.add(at, large_products(asked, there)[at, of], ids[of])
            return
        norms = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1)), np.sqrt((there.astype(np.float64) ** 2).sum(axis=1))
        left, right = np.arange(len(asked)), np.arange(len(there))
        for segments in LEVELS:
            least = self.best.least[left]
            if (least == least.min()).all() and len(least) and least[0] == np.iinfo(np.int64).min:
                break  # nothing to hold bounds against yet
            upper = statistics(asked[left], segments) @ statistics(there[right], segments).T + 1e-9 * norms[0][left][:, None] * norms[1][right] + 1e-6
            live &= upper >= least[:, None]
            own, other = live.any(axis=1), live.any(axis=0)
            live, left, right = live[np.ix_(own, other)], left[own], right[other]
            if not live.size:
                return
        at, of = np.nonzero(live)
        self.scored += len(at)
        a, b = asked[left].astype(np.float64), there[right].astype(np.float64)
        if len(at) > SPARSE * live.size:
            score = (a @ b.T)[at, of]
        else:
            score = np.concatenate([np.einsum("ij,ij->i", a[at[i : i + 50_000]], b[of[i : i + 50_000]]) for i in range(0, len(at), 50_000)]) if len(at) else np.empty(0)
        self.best.add(left[at], score.astype(np.int64), ids[right[of]])

    def result(self):
        yield from batches_of(["query_id", "vec_id", "score"], self.ids[self.best.place], self.best.ids, self.best.score)


def top_products(df: DataFrame, query, k: int = 5, vector: str = "embedding", key: str = "vec_id", per_block: int = BLOCK, per_task: int = PER_TASK, least_part: int = LEAST_PART) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that the condition `query` names, the k highest integer inner products with other rows.

    Vectors become integers by floor(256 * x). Rows without id and vectors that are null or hold null or
    non-finite components take no part; an empty vector's products are 0. Rows of the query's own id are no
    candidates of it; of query rows that share an id the least vector asks, candidates that share one are rows
    of their own. Equal scores: the smaller id first. Other columns are ignored, an empty table gives no rows.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), integer_vectors(df, vector).alias("v"), query.alias("asks")).where("id is not null and v is not null")
    rows = rows.withColumn("key", F.lit(0).cast("long"))
    asked = rows.where("asks").groupBy("key", "id").agg(F.min("v").alias("v"))
    found = against(asked, rows.drop("asks"), lambda block: Search(block, k), "query_id long, vec_id long, score long", per_block, per_task, least_part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
