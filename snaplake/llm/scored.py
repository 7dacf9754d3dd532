"""Integer vectors, and asked rows against all rows in blocks: what exact search and hard negatives share.

Components become floor(256 * x), x as double. Where a component is so large that a score could leave the
range of exact doubles (2**53), scores are taken with Python's integers; what leaves the range of a long
counts as its nearest end. Vectors of different lengths are filled up with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import durable, tasks

#: Asked rows of a block, rows that one task reads for a block at most, rows that a part has at least where tasks are wanted, rows compared at once.
BLOCK, PER_TASK, LEAST_PART, STEP = 256, 4_000_000, 800, 2_048
#: Keys whose counts may be broadcast.
BROADCAST_KEYS = 100_000
#: Score of a place that isn't taken.
NONE = np.iinfo(np.int64).min


def integer_vectors(df: DataFrame, vector: str):
    """Column: floor(256 * x) of every component as array<bigint>; null for null vectors and those with null or non-finite components."""
    good = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


def matrix(column) -> np.ndarray:
    """A column of lists of longs as rows of one matrix, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    width = np.diff(at)
    out = np.zeros((len(width), int(width.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < width[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray, multiple: int = 1) -> tuple[np.ndarray, np.ndarray]:
    width = -(-max(a.shape[1], b.shape[1], 1) // multiple) * multiple
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def exact_in_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every inner product of rows of a and b, and every part of it, is exact in doubles."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + 1 for x in (a, b)]
    return 2 * most[0] * most[1] * a.shape[1] < 2**53


def large_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with rows of b by Python's integers, held within the range of a long."""
    return np.clip(a.astype(object) @ b.astype(object).T, NONE + 1, 2**63 - 1).astype(np.int64)


class Best:
    """The k highest scores of each of n places, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, NONE)
        self.place = self.score = self.ids = np.empty(0, np.int64)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        may = score >= self.least[place]
        if not may.any():
            return
        place, score, ids = (np.concatenate([x, y[may]]) for x, y in zip((self.place, self.score, self.ids), (place, score, ids)))
        order = np.lexsort((ids, -score, place))
        place, score, ids = place[order], score[order], ids[order]
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        nth = np.arange(len(place)) - np.repeat(start, np.diff(np.r_[start, len(place)]))
        kept = nth < self.k
        self.place, self.score, self.ids = place[kept], score[kept], ids[kept]
        last = nth[kept] == self.k - 1
        self.least[self.place[last]] = self.score[last]


def against(asked: DataFrame, rows: DataFrame, meet, schema: str, per_block: int = BLOCK, per_task: int = PER_TASK, least_part: int = LEAST_PART) -> DataFrame:
    """What meet makes of the asked rows of each key and all rows of the same key, block by block.

    Both have key and id (long); columns of only one are null in the other. The asked rows of a key are cut by
    hash into blocks of about `per_block`, its rows into parts that no more than `per_task` rows go into; each
    block meets each part in one task, which holds the block and reads the part as a stream. meet(batch of the
    block) gives an object with add(batch of rows) and result(), which gives record batches of the schema.
    """
    n_tasks = tasks(rows)
    there = rows.groupBy("key").agg(F.count("*").alias("there"))
    sizes = asked.groupBy("key").agg(F.count("*").alias("wanted")).join(there, "key")
    blocks = F.ceil(F.col("wanted") / per_block)
    spread = F.least(F.ceil(F.col("there") / least_part), F.ceil(n_tasks / blocks))
    sizes = durable(sizes.select("key", blocks.cast("int").alias("blocks"), F.greatest(F.ceil(F.col("there") / per_task), spread).cast("int").alias("parts")))
    hint = F.broadcast if sizes.count() <= BROADCAST_KEYS else lambda x: x

    def dealt(df, own, other, is_row):
        numbered = df.join(hint(sizes), "key").withColumn("_own", F.pmod(F.xxhash64("id", F.lit(own)), F.col(own)).cast("int"))
        return numbered.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(*df.columns, F.col("_own").alias(own[:-1]), F.col("_other").alias(other[:-1]), F.lit(is_row).alias("is_row"))

    both = dealt(asked, "blocks", "parts", 0).unionByName(dealt(rows, "parts", "blocks", 1), allowMissingColumns=True)
    order = ["key", "block", "part", "is_row"]

    def run(batches):
        now, held, met = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in order])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                key, part = tuple(at[:3, low].tolist()), batch.slice(low, high - low)
                if key != now:
                    if met:
                        yield from met.result()
                    now, held, met = key, [], None
                if not at[3, low]:
                    held.append(part)
                    continue
                if held and not met:
                    met = meet(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                if met:
                    for i in range(0, part.num_rows, STEP):
                        met.add(part.slice(i, STEP))
        if met:
            yield from met.result()

    return both.repartition(n_tasks, *order[:3]).sortWithinPartitions(*order).mapInArrow(run, schema)


def batches_of(names: list[str], *columns: np.ndarray):
    for i in range(0, len(columns[0]), 50_000):
        yield pa.record_batch([pa.array(c[i : i + 50_000]) for c in columns], names=names)
