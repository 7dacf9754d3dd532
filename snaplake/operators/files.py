"""Changed files held against what was expected of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.operators.invariants import BROADCAST_SPECS

_SPEC = "path string, content string, content_contains string, file_type string, size long"


def lookup(files: DataFrame, path: str, avoid: str | None = None, path_col: str = "path") -> DataFrame:
    """The file at the path or, if there is none, the shortest one whose path ends with it, ties by path; those that contain `avoid` come last."""
    c = F.col(path_col)
    found = files.where((c == path) | c.endswith("/" + path.lstrip("/")))
    away = F.contains(c, F.lit(avoid)) if avoid else F.lit(False)
    return found.orderBy(c != path, away, F.char_length(c), c).limit(1)


def shortest(files: DataFrame, by: str, path_col: str = "path") -> DataFrame:
    """(by, path): the shortest path of each group, ties by path."""
    return files.groupBy(by).agg(F.min_by(path_col, F.struct(F.char_length(path_col), path_col)).alias(path_col))


def expect_files(changed: DataFrame, specs: list[dict]) -> DataFrame:
    """(path, problem, expected) for changed files (path, content, file_type, size) that don't meet the specs.

    specs: dicts with a path and what the file must have: content, content_contains, file_type, size; `...`
    or nothing checks nothing. Problems: unexpected (no spec has the path), missing (a spec's path didn't
    change, told once), unavailable (the content to be checked is null), content, content_contains,
    file_type, size. Of several specs for one path all are checked. Specs are few: they are broadcast, up to BROADCAST_SPECS of them.
    """
    if any(s.get("path") is None for s in specs):
        raise ValueError("a spec needs a path")
    names = [part.split()[0] for part in _SPEC.split(", ")]
    rows = [tuple(None if s.get(n) is ... else s.get(n) for n in names) for s in specs]
    wanted = changed.sparkSession.createDataFrame(rows, _SPEC)
    wanted = wanted.select("path", *(F.col(n).alias(f"w_{n}") for n in names[1:]))
    sent = F.broadcast if len(specs) <= BROADCAST_SPECS else lambda df: df
    met = changed.join(sent(wanted), "path")
    asked = F.col("w_content").isNotNull() | F.col("w_content_contains").isNotNull()
    tell = lambda bad, problem, expected: F.when(bad, F.struct(F.lit(problem).alias("problem"), expected.cast("string").alias("expected")))
    problems = F.array_compact(F.array(
        tell(F.col("content").isNull() & asked, "unavailable", F.coalesce("w_content", "w_content_contains")),
        tell(F.col("content") != F.col("w_content"), "content", F.substring("w_content", 1, 200)),
        tell(~F.contains("content", "w_content_contains"), "content_contains", F.substring("w_content_contains", 1, 200)),
        tell(F.col("w_file_type").isNotNull() & ~F.col("file_type").eqNullSafe(F.col("w_file_type")), "file_type", F.col("w_file_type")),
        tell(F.col("w_size").isNotNull() & ~F.col("size").eqNullSafe(F.col("w_size")), "size", F.col("w_size")),
    ))
    wrong = met.select("path", F.explode(problems).alias("p")).select("path", "p.problem", "p.expected")
    alone = changed.join(sent(wanted.select("path")), "path", "left_anti").select("path", F.lit("unexpected").alias("problem"), F.lit(None).cast("string").alias("expected"))
    there = changed.join(sent(wanted.select("path")), "path", "left_semi").select("path").distinct()
    missing = wanted.select("path").distinct().join(there, "path", "left_anti").select("path", F.lit("missing").alias("problem"), F.lit(None).cast("string").alias("expected"))
    return wrong.unionByName(alone).unionByName(missing)
