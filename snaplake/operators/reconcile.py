"""Changes between two large tables that differ in few rows: digests of key ranges first, rows only where they differ.

Rows are digested and summed by ranges of their keys' hashes: an aggregate of a few thousand rows a task, however
large the table. Ranges whose number or sums differ are cut finer, until few rows lie in them; only these rows are
shuffled and compared. Digests are sums of two 64-bit hashes with the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.catalog import durable
from snaplake.operators.diff import Ignore, table_changes

#: Ranges of the first round, ranges that one is cut into, rows in differing ranges that are compared without cutting on, rounds.
RANGES, FINER, FEW, ROUNDS = 4096, 64, 200_000, 4
#: Differing ranges up to which they are broadcast; beyond it the tables differ all over and are compared as wholes.
MANY = 200_000


def _side(df: DataFrame, keys: list[str], names: list[str], kinds: dict[str, str]) -> DataFrame:
    """_key (hash of the keys), _row and _row2 (of all compared columns), and the columns themselves."""
    values = [F.struct(F.lit(c), c_.isNull(), c_) for c in names for c_ in [(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kinds[c])]]
    key = F.xxhash64(*(F.col(f"`{k}`").cast(kinds[k]) for k in keys))
    return df.select("*", key.alias("_key"), F.xxhash64(*values).alias("_row"), F.xxhash64(F.lit(1), *values).alias("_row2"))


def _range(ranges: int):
    return F.shiftrightunsigned("_key", 1) % ranges


def differing(before: DataFrame, after: DataFrame, ranges: int, within: DataFrame | None, outer: int) -> DataFrame:
    """(range, rows: of both sides) of the ranges whose sums differ; within: those of the round before, cut out of `outer`."""

    def told(side, sign):
        side = side.withColumn("range", _range(ranges))
        if within is not None:
            side = side.withColumn("_outer", F.col("range") % outer).join(F.broadcast(within), "_outer", "left_semi")
        wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)") * sign)
        return side.groupBy("range").agg((F.count("*") * sign).alias("n"), F.count("*").alias("rows"), wide("_row").alias("a"), wide("_row2").alias("b"))

    net = told(before, -1).unionAll(told(after, 1)).groupBy("range").agg(*(F.sum(c).alias(c) for c in ("n", "rows", "a", "b")))
    return durable(net.where("n <> 0 or a <> 0 or b <> 0").select("range", "rows"))


def reconciled_changes(before: DataFrame, after: DataFrame, keys: list[str], table: str = "", ignore: Ignore = Ignore(), ranges: int = RANGES, finer: int = FINER, few: int = FEW) -> DataFrame:
    """CHANGES as table_changes gives them, for tables whose keys are unique. Rows with a null key pair with nothing there; they are compared in any case.

    Each round reads the two tables and shuffles sums; rows are shuffled once, those of differing ranges.
    """
    names = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c in keys or not ignore.skips(table, c)]
    kinds = {**dict(after.dtypes), **dict(before.dtypes)}
    left, right = (_side(x, keys, names, kinds) for x in (before, after))
    found, outer = differing(left, right, ranges, None, 0), 0
    for _ in range(ROUNDS):
        n, rows = found.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if n > MANY:
            return table_changes(before, after, keys, table, ignore)
        if rows <= few:
            break
        # a range of the finer cut lies in the one that its number leaves as remainder
        outer, ranges = ranges, ranges * finer
        closer = differing(left, right, ranges, found.select(F.col("range").alias("_outer")), outer)
        if closer.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] > rows / 2:  # most rows there differ: cutting on is of no use
            found = closer
            break
        found = closer
    unknown = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys])
    hit = F.broadcast(found.select(F.col("range"), F.lit(True).alias("_hit"))) if found.count() <= MANY else found.select("range", F.lit(True).alias("_hit"))
    chosen = [side.withColumn("range", _range(ranges)).join(hit, "range", "left").where(F.col("_hit") | unknown).select(*x.columns) for side, x in ((left, before), (right, after))]
    return table_changes(*chosen, keys, table, ignore)
