"""Hard negatives by bit-sliced integer products.

A row's components are read as bit planes, most significant first (the first one is the sign's, and counts
negative). After the planes down to bit j, what is left of each component lies from 0 to 2**j - 1, so an
anchor's product with the row lies between the partial product plus (2**j - 1) times the sum of the anchor's
negative components and the same with its positive ones. Intervals that can't reach a place in the anchor's
list any more are dropped after each plane; after the last one the product is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaplake.llm.common import durable
from snaplake.llm.scored import BLOCK, LEAST_PART, NONE, PER_TASK, Best, against, batches_of, exact_in_doubles, integer_vectors, large_products, matrix, same_width

#: Part of the pairs under which planes are added pair by pair.
SPARSE = 0.06


class Mining:
    """The k highest products of each list, an anchor and a range of scores, with rows of the anchor's label or of others.

    The anchors' batch has id, label, v and, for lists with a range, nth, low and high (arrays of as many longs);
    without these each anchor has one list of any score.
    """

    def __init__(self, anchors, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.same, self.k = anchors.column("id").to_numpy(), anchors.column("label").to_numpy(), matrix(anchors.column("v")), same, k
        if "low" in anchors.schema.names and anchors.column("low").null_count < anchors.num_rows:
            sizes = anchors.column("low").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            self.owner = np.repeat(np.arange(len(self.ids)), sizes)
            self.nth, self.low, self.high = (anchors.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("nth", "low", "high"))
        else:
            self.owner = np.arange(len(self.ids))
            self.nth, self.low, self.high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), NONE), np.full(len(self.ids), 2**63 - 1)
        self.best, self.pairs, self.left_by_plane = Best(len(self.owner), k), 0, {}

    def add(self, rows) -> None:
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        anchors, there = same_width(self.vectors, matrix(rows.column("v")))
        may = ((self.labels[:, None] == labels) == self.same) & (self.ids[:, None] != ids)
        live = may[self.owner]
        self.pairs += live.size
        if not exact_in_doubles(anchors, there):
            at, of = np.nonzero(live)
            score = large_products(anchors, there)[self.owner[at], of]
        else:
            at, of, score = self.by_planes(anchors.astype(np.float64), there, live)
        inside = (score >= self.low[at]) & (score <= self.high[at])
        self.best.add(at[inside], score[inside], ids[of[inside]])

    def by_planes(self, anchors, there, live):
        """(list, row, product) of the pairs that are left when all planes are read."""
        bits = max(int(there.max(initial=0)).bit_length(), int(-1 - there.min(initial=0)).bit_length()) + 1
        above, below = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
        lists, cols = np.arange(len(self.owner)), np.arange(len(there))
        partial = np.zeros((len(anchors), len(there)))  # anchors by rows, until few pairs are left; then one number a pair
        least = np.maximum(self.best.least, self.low)
        at = of = None
        for j in reversed(range(bits)):
            plane = ((there >> j) & 1).astype(np.float64)
            weight = -(2.0**j) if j == bits - 1 else 2.0**j
            rest = 2.0**j - 1
            if at is None:
                partial += weight * (anchors @ plane[cols].T)
                whose = self.owner[lists]
                low, high = partial[whose] + (rest * below)[whose, None], partial[whose] + (rest * above)[whose, None]
                # k rows that surely lie in the range: what can't reach the least of them goes
                sure = np.where(live & (low >= self.low[lists, None]) & (high <= self.high[lists, None]), low, -np.inf)
                if sure.shape[1] >= self.k:
                    kth = -np.partition(-sure, self.k - 1, axis=1)[:, self.k - 1]
                    least[lists] = np.maximum(least[lists], np.where(np.isfinite(kth), np.where(np.isfinite(kth), kth, 0).astype(np.int64), NONE))
                live &= (high >= least[lists, None]) & (low <= self.high[lists, None])
                own, other = live.any(axis=1), live.any(axis=0)
                live, lists, cols, partial = live[np.ix_(own, other)], lists[own], cols[other], partial[:, other]
                n = int(live.sum())
                if n < SPARSE * max(live.size, 1):
                    x, y = np.nonzero(live)
                    at, of, partial = lists[x], cols[y], partial[self.owner[lists[x]], y]
            else:
                partial = partial + weight * np.concatenate([np.einsum("ij,ij->i", anchors[self.owner[at[i : i + 50_000]]], plane[of[i : i + 50_000]]) for i in range(0, max(len(at), 1), 50_000)])
                own = self.owner[at]
                kept = (partial + rest * above[own] >= least[at]) & (partial + rest * below[own] <= self.high[at])
                at, of, partial = at[kept], of[kept], partial[kept]
                n = len(at)
            self.left_by_plane[j] = self.left_by_plane.get(j, 0) + n
        if at is None:
            x, y = np.nonzero(live)
            at, of, partial = lists[x], cols[y], partial[self.owner[lists[x]], y]
        return at, of, partial.astype(np.int64)

    def result(self):
        best = self.best
        yield from batches_of(["anchor_id", "nth", "other_id", "score"], self.ids[self.owner[best.place]], self.nth[best.place], best.ids, best.score)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def with_ranges(anchors: DataFrame, positives: DataFrame, least: int, most: int) -> DataFrame:
    """The anchors with nth, low and high of their positives: products from least to most hundredths of the positive's."""
    by = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))

    def ranges(batches):
        for batch in batches:
            listed = [[(x["rank"], x["score"]) for x in p] for p in batch.column("p").to_pylist()]
            kind = pa.list_(pa.int64())
            low, high = [[-(-least * s // 100) for _, s in p] for p in listed], [[most * s // 100 for _, s in p] for p in listed]
            yield pa.record_batch([batch.column("anchor_id"), *(pa.array(x, kind) for x in ([[n for n, _ in p] for p in listed], low, high))], names=["id", "nth", "low", "high"])

    return anchors.join(by.mapInArrow(ranges, "id long, nth array<long>, low array<long>, high array<long>"), "id")


def hard_negatives(df: DataFrame, anchor, n_positive: int = 5, n_negative: int = 10, least: int = 30, most: int = 90, vector: str = "embedding", key: str = "vec_id", label="label", per_block: int = BLOCK, per_task: int = PER_TASK, least_part: int = LEAST_PART) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that the condition `anchor` names; an anchor's positives are the n_positive other rows of
    its label with the highest products. For each of them, the n_negative highest products with rows of other
    labels that lie from `least` to `most` hundredths of the positive's (a negative positive score has none, 0
    only 0). Rows without id, label or vector and vectors with null or non-finite components take no part. Of
    anchor rows that share an id, the one of least label and vector asks; rows of an anchor's own id are neither
    its positives nor its negatives; other rows that share an id stand for themselves. Equal products: the
    smaller id first. Other columns are ignored, an empty table gives no rows. `label`: a column or its name.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), integer_vectors(df, vector).alias("v"), anchor.alias("asks")).where("id is not null and label is not null and v is not null")
    anchors = durable(rows.where("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"))
    rows = rows.drop("asks")
    schema = "anchor_id long, nth long, other_id long, score long"
    by_label = [x.withColumn("key", F.col("label")) for x in (anchors, rows)]
    found = against(*by_label, lambda block: Mining(block, n_positive, True), schema, per_block, per_task, least_part)
    positives = durable(ranked(found, n_positive).select("anchor_id", "rank", F.col("other_id").alias("positive_id"), "score"))
    asked = with_ranges(anchors, positives, least, most).withColumn("key", F.lit(0).cast("long"))
    found = against(asked, rows.withColumn("key", F.lit(0).cast("long")), lambda block: Mining(block, n_negative, False), schema, per_block, per_task, least_part)
    negatives = ranked(found, n_negative).select("anchor_id", "nth", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    whose = positives.select("anchor_id", F.col("rank").cast("long").alias("nth"), "positive_id", F.col("score").alias("positive_score"))
    return negatives.join(whose, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
