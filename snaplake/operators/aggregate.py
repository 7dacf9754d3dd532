"""Aggregates from request bodies, and the rollups of jobs and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.operators.filters import compile_filter


def _metric(spec) -> Column:
    """'count', {'sum'|'min'|'max'|'avg'|'distinct': column}."""
    if spec == "count":
        return F.count("*")
    (kind, c), = spec.items()
    return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "distinct": F.count_distinct}[kind](c)


def aggregate(rows: DataFrame, body: dict) -> DataFrame:
    """Groups of rows. body: group_by (columns), time_bucket {field, interval}, metrics {name: metric}, filters,
    having (a filter over metrics and keys), order_by [(name, 'asc' or 'desc')], limit.

    The bucket's column is called bucket; weeks start on Monday. Partial sums are made before the shuffle, so
    a large group costs no more than a small one. Order is made total by the keys.
    """
    if body.get("filters"):
        rows = rows.where(compile_filter(body["filters"]))
    keys = [F.col(c) for c in body.get("group_by", [])]
    if bucket := body.get("time_bucket"):
        keys.append(F.date_trunc(bucket["interval"], F.col(bucket["field"])).alias("bucket"))
    out = rows.groupBy(*keys).agg(*(_metric(m).alias(n) for n, m in body.get("metrics", {"count": "count"}).items()))
    if body.get("having"):
        out = out.where(compile_filter(body["having"]))
    if body.get("order_by") or body.get("limit") is not None:
        order = [F.col(n).desc() if d == "desc" else F.col(n).asc() for n, d in body.get("order_by", [])]
        names = [*body.get("group_by", []), *(["bucket"] if bucket else [])]
        out = out.orderBy(*order, *names)
    return out if body.get("limit") is None else out.limit(body["limit"])


def pass_rates(runs: DataFrame, task: str, passed: str, score: str) -> DataFrame:
    """(task, total, passed, pass_rate, average_score) with null scores left out of the mean."""
    return runs.groupBy(task).agg(F.count("*").alias("total"), F.count_if(F.col(passed)).alias("passed"), (F.count_if(F.col(passed)) / F.count("*")).alias("pass_rate"), F.avg(score).alias("average_score"))


def error_breakdown(errors: DataFrame, category: str, example: str, most: int = 5) -> DataFrame:
    """(category, n, examples): counts, and the `most` least examples of each. Examples are merged before the shuffle, `most` of each task."""
    once = errors.select(category, example).distinct()
    from pyspark.sql import Window

    ranked = once.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy(example))).where(f"_r <= {most}")
    shown = ranked.groupBy(category).agg(F.sort_array(F.collect_list(example)).alias("examples"))
    return errors.groupBy(category).agg(F.count("*").alias("n")).join(shown, category)


def normalised_score(score: Column, most: Column) -> Column:
    """score / most to four places; the score itself if most is 0."""
    return F.round(F.when(most > 0, score / most).otherwise(score), 4)
