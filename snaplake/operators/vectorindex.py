"""A stored index for semantic search: vectors by cell and by distance to the cell's centre, read where the triangle bound lets a good one be.

Vectors count by direction. A bounded sample gives the centres; every vector goes to the nearest one and is stored
by cell and distance d to the centre, so that a cell is cut into rings and large cells lie in many files. A vector
with distance t or less to the query has a d that differs by t at most from the query's distance to that centre; so
each cell is read in one interval of d, or not at all. Results equal those of search.semantic over all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.operators.search import semantic, top

#: Cells at most; rings of a cell by unit of distance (unit vectors are 2 apart at most); rows and bytes of the sample that centres are fitted on; cells that a filter names one by one.
CELLS, RINGS, SAMPLE, SAMPLE_BYTES, NAMED = 1024, 32, 20_000, 64_000_000, 200
#: What rounding may add to a distance.
SLACK = 1e-6
_PAGES = {"parquet.block.size": 16_000_000, "parquet.page.row.count.limit": 500}
_SCHEMA = "cell int, d double, ring int, id long, vector array<double>"


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector of the rows with an id and a direction."""
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)  # null or NaN if a component is
    return out.where((squares > 0) & (squares < float("inf")))


def _arrays(column) -> np.ndarray:
    """Vectors of equal length, a row each, as unit vectors."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


def _fitted(sample: np.ndarray, cells: int, rounds: int = 5) -> np.ndarray:
    """Centres by some rounds of k-means from the first rows; cells that lose all rows keep their centre."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        cell = np.concatenate([_nearest(sample[i : i + 2_000], centres) for i in range(0, len(sample), 2_000)])
        n = np.bincount(cell, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, cell, sample)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def build(rows: DataFrame, id_col: str, vector_col: str, folder: str, cells: int | None = None) -> None:
    """Writes the index of a table's vectors, in place of one that is there.

    Rows without id and vectors that are null, empty, zero or hold null or non-finite components are left out, as
    are vectors of another length than most have; repeated rows stay. cells: the square root of their number
    unless given, 1,024 at most; their rings are as many as a vector's distance allows, so what a search plans with
    is bounded. No usable row: an index that finds nothing.
    """
    spark = rows.sparkSession
    known = _usable(rows, id_col, vector_col)
    sizes = known.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims, n = (sizes["dims"], sizes["count"]) if sizes else (0, 0)
    known = known.where(F.size("vector") == dims)
    cells = max(1, min(CELLS, cells or math.ceil(math.sqrt(n))))
    most = max(cells, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, dims))))
    taken = known.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toArrow()
    centres = _fitted(_arrays(taken.column("vector")), cells) if taken.num_rows else np.empty((0, 0))
    shared = spark.sparkContext.broadcast(centres)

    def placed(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 2_000):
                batch = whole.slice(i, 2_000)
                x = _arrays(batch.column("vector"))
                cell = _nearest(x, shared.value)
                d = np.linalg.norm(x - shared.value[cell], axis=1)
                yield pa.record_batch([pa.array(cell.astype(np.int32)), pa.array(d), pa.array((d * RINGS).astype(np.int32)), batch.column("id"), batch.column("vector")], names=["cell", "d", "ring", "id", "vector"])

    dealt = known.mapInArrow(placed, _SCHEMA).repartitionByRange("cell", "d", "id").sortWithinPartitions("cell", "d", "id")
    dealt.write.mode("overwrite").options(**_PAGES).parquet(f"{folder}/vectors")
    stored = spark.read.schema(_SCHEMA).parquet(f"{folder}/vectors")
    stored.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/rings")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")


class _Plan:
    """What a search knows before it reads vectors: rings (65 a cell at most), and the query's distance to their centres."""

    def __init__(self, spark: SparkSession, folder: str, query: list[float]):
        q = np.array(query, np.float64)
        norm = np.linalg.norm(q)
        if not np.isfinite(norm) or norm == 0:
            raise ValueError("a query needs a direction")
        centres = dict(map(tuple, spark.read.parquet(f"{folder}/centres").collect()))
        if centres and len(q) != len(next(iter(centres.values()))):
            raise ValueError(f"the index has vectors of {len(next(iter(centres.values())))} numbers, the query has {len(q)}")
        away = {c: float(np.linalg.norm(q / norm - np.array(x))) for c, x in centres.items()}
        rings = spark.read.parquet(f"{folder}/rings").orderBy("cell", "ring").collect()
        self.cell, self.n, self.low, self.high = (np.array([r[c] for r in rings]) for c in ("cell", "n", "low", "high"))
        self.away = np.array([away[r.cell] for r in rings])
        self.bound = np.maximum(0, np.maximum(self.away - self.high, self.low - self.away)) if rings else np.empty(0)
        self.rows = spark.read.schema(_SCHEMA).parquet(f"{folder}/vectors")

    def nearest(self, k: int) -> np.ndarray:
        """The rings that lie next to the query, with k vectors or more together."""
        order = np.argsort(self.bound, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(self.n[order]), k)) + 1]

    def read(self, rings: np.ndarray) -> DataFrame:
        """The vectors of these rings; those between two of a cell come with them."""
        spans: dict[int, tuple[float, float]] = {}
        for i in rings.tolist():
            low, high = spans.get(int(self.cell[i]), (math.inf, -math.inf))
            spans[int(self.cell[i])] = min(low, float(self.low[i])), max(high, float(self.high[i]))
        if not spans:
            return self.rows.limit(0)
        chosen = self.rows.where(F.col("cell").isin(sorted(spans)))
        if len(spans) <= NAMED:
            return chosen.where(_either([(F.col("cell") == c) & F.col("d").between(*s) for c, s in sorted(spans.items())]))
        known = self.rows.sparkSession.createDataFrame([(c, *s) for c, s in sorted(spans.items())], "cell int, low double, high double")
        return chosen.join(F.broadcast(known), "cell").where(F.col("d").between(F.col("low"), F.col("high")))  # a row a cell


def _either(terms: list[Column]) -> Column:
    while len(terms) > 1:
        terms = [terms[i] | terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def _distance(score: float) -> float:
    """Of unit vectors with this cosine."""
    return math.sqrt(max(0.0, 2 - 2 * score)) + SLACK


def search(spark: SparkSession, folder: str, query: list[float], k: int) -> DataFrame:
    """(id, score): the k best by cosine, ties by id, equal to top(semantic(...), k). Fewer vectors: all. ValueError for a query without direction or of another length."""
    plan = _Plan(spark, folder, query)
    scored = lambda rings: top(semantic(plan.read(rings), "id", "vector", query), k)
    every = np.arange(len(plan.n))
    if int(plan.n.sum()) > k:
        found = [r.score for r in scored(plan.nearest(k)).collect()]  # k rows
        every = np.flatnonzero(plan.bound <= _distance(found[-1]))
    return scored(every)


def within(spark: SparkSession, folder: str, query: list[float], least: float) -> DataFrame:
    """(id, score) of all vectors with a cosine of `least` or more."""
    plan = _Plan(spark, folder, query)
    return semantic(plan.read(np.flatnonzero(plan.bound <= _distance(least))), "id", "vector", query).where(F.col("score") >= least)
