"""Manifests of many files as stored hash trees: updated along changed paths, compared by descending where sums differ.

A file's place is the hexadecimal digest of its path; the node of a prefix holds the number of files below it and
two sums of their hashes. Sums of a prefix don't depend on how deep a tree is, so trees of different depth compare,
and a change of a file adds the same difference to every node above it: an update appends rows for the changed
files and their nodes and reads no others. Depth grows with the number of files, so that the last level's nodes
have some hundred files each.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a node of the last level on average, digits of a file's place, nodes that are looked up by name.
LEAF, DIGITS, NAMED = 256, 12, 1_000
#: Small pages, so that a prefix is read without its neighbours.
_PAGES = {"parquet.block.size": 4_000_000, "parquet.page.row.count.limit": 1_000}
_SUMS = ("n", "a", "b")


def _placed(files: DataFrame) -> DataFrame:
    return files.withColumn("place", F.substring(F.sha2("path", 256), 1, DIGITS))


def _signed(rows: DataFrame, sign) -> DataFrame:
    """place, n, a, b of rows with path and sha256, times the sign."""
    wide = lambda *c: F.xxhash64(*c).cast("decimal(38,0)") * sign
    return rows.select("place", F.lit(sign).cast("long").alias("n"), wide("path", "sha256").alias("a"), wide(F.lit("b"), "sha256", "path").alias("b"))


def _nodes(signed: DataFrame, depth: int) -> DataFrame:
    """level, prefix, n, a, b of all levels: the last one from the files, each other one from that below."""
    at = signed.groupBy(F.substring("place", 1, depth).alias("prefix")).agg(*(F.sum(c).cast("decimal(38,0)" if c != "n" else "long").alias(c) for c in _SUMS))
    levels = []
    for level in range(depth, -1, -1):
        if level < depth:
            at = at.groupBy(F.substring("prefix", 1, level).alias("prefix")).agg(*(F.sum(c).cast("decimal(38,0)" if c != "n" else "long").alias(c) for c in _SUMS))
        levels.append(at.select(F.lit(level).alias("level"), "prefix", *_SUMS))
    return reduce(DataFrame.unionAll, levels)


def build(files: DataFrame, folder: str, leaf: int = LEAF) -> int:
    """Writes the tree of files (path: unique, sha256), in place of one that is there; gives its depth."""
    n = files.count()
    depth = min(DIGITS - 1, max(1, math.ceil(math.log(max(n, 1) / leaf, 16)))) if n > leaf else 1
    placed = _placed(files.select("path", "sha256"))
    parts = max(1, n // 1_000_000)
    placed.withColumn("version", F.lit(0)).repartitionByRange(parts, "place").sortWithinPartitions("place").write.mode("overwrite").options(**_PAGES).parquet(f"{folder}/files")
    none = files.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("n"), *(F.lit(0).cast("decimal(38,0)").alias(c) for c in "ab"))
    nodes = _nodes(_signed(placed, 1), depth).unionAll(none).withColumn("version", F.lit(0))  # none: a root, if there are no files
    nodes.repartitionByRange(parts, "level", "prefix").sortWithinPartitions("level", "prefix").write.mode("overwrite").options(**_PAGES).partitionBy("level").parquet(f"{folder}/nodes")
    return depth


def _prefixed(column: str, prefixes: list[str]):
    """The column starts with one of the prefixes: a filter that Parquet's page statistics answer."""
    terms = [F.col(column).startswith(p) for p in prefixes] or [F.lit(False)]
    while len(terms) > 1:  # a balanced tree: a chain of a thousand would be too deep
        terms = [reduce(lambda a, b: a | b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def _stored(spark: SparkSession, folder: str, prefixes: list[str] | None) -> DataFrame:
    """place, path, sha256 of the files below the prefixes (None: all): of each path the last version, removed ones left out."""
    rows = spark.read.parquet(f"{folder}/files")
    rows = rows if prefixes is None else rows.where(_prefixed("place", prefixes))
    return rows.groupBy("place", "path").agg(F.max_by("sha256", "version").alias("sha256")).where("sha256 is not null")


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) of the whole tree."""
    return _stored(spark, folder, None).select("path", "sha256")


def depth_of(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/nodes").select("level").distinct().agg(F.max("level")).first()[0]


def root(spark: SparkSession, folder: str) -> DataFrame:
    """(n, root): the number of files and a digest of all, whatever their order and the tree's depth."""
    top = spark.read.parquet(f"{folder}/nodes").where("level = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS))
    return top.select(F.col("n"), F.sha2(F.concat_ws("/", "n", "a", "b"), 256).alias("root"))


def apply(spark: SparkSession, folder: str, changes: DataFrame) -> None:
    """Files (path: unique, sha256; null: removed) after a change: rows are appended for these and the nodes above them. Of the tree's files only the changed ones are looked up."""
    placed = _placed(changes.select("path", "sha256")).cache()
    names = [r.place for r in placed.select("place").limit(NAMED + 1).collect()]
    old = _stored(spark, folder, names if len(names) <= NAMED else None).join(placed.select("path"), "path", "left_semi").cache()
    depth, version = depth_of(spark, folder), spark.read.parquet(f"{folder}/nodes").where("level = 0").agg(F.max("version")).first()[0] or 0
    moved = _signed(old, -1).unionAll(_signed(placed.where("sha256 is not null"), 1))
    _nodes(moved, depth).where("level = 0 or n <> 0 or a <> 0 or b <> 0").withColumn("version", F.lit(version + 1)).coalesce(1).write.mode("append").options(**_PAGES).partitionBy("level").parquet(f"{folder}/nodes")
    placed.withColumn("version", F.lit(version + 1)).coalesce(1).sortWithinPartitions("place").write.mode("append").options(**_PAGES).parquet(f"{folder}/files")
    placed.unpersist()
    old.unpersist()


def changed_prefixes(spark: SparkSession, here: str, there: str) -> list[str]:
    """The prefixes, as long as both trees are deep, below which they differ; a level is read only below what differs above. More than NAMED: too many to name, NAMED + 1 of them."""
    prefixes = [""]
    for level in range(min(depth_of(spark, here), depth_of(spark, there)) + 1):

        def told(folder, sign, level=level, prefixes=prefixes):
            nodes = spark.read.parquet(f"{folder}/nodes").where(F.col("level") == level)
            return nodes.where(_prefixed("prefix", prefixes)).select("prefix", *((F.col(c) * sign).alias(c) for c in _SUMS))

        net = told(here, 1).unionAll(told(there, -1)).groupBy("prefix").agg(*(F.sum(c).alias(c) for c in _SUMS)).where("n <> 0 or a <> 0 or b <> 0")
        prefixes = [r.prefix for r in net.select("prefix").limit(NAMED + 1).collect()]
        if not prefixes or len(prefixes) > NAMED:
            break
    return prefixes


def tree_diff(spark: SparkSession, here: str, there: str, removed: bool = True) -> DataFrame:
    """(path, sha256, status) as manifest_diff gives it, for two stored trees: files are read below the differing nodes only."""
    from snaplake.operators.sync import manifest_diff

    prefixes = changed_prefixes(spark, here, there)
    sides = [_stored(spark, f, None if len(prefixes) > NAMED else prefixes) for f in (here, there)]
    return manifest_diff(*sides, removed=removed)
