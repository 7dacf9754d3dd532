"""Rollups of queues, runs, jobs, files, events and activity. All are aggregates with partial sums before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that an event's wrapping costs, share of a window that is used, window where neither model nor tool is known.
WRAPPING, MARGIN, UNKNOWN_WINDOW = 90, 0.85, 100_000


def counts_by_each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): counts by each of several columns, in one pass."""
    texts = rows.select(*(F.col(c).cast("string").alias(c) for c in columns))
    return texts.unpivot([], columns, "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


def by_key(rows: DataFrame, keys: list[str], first: str) -> DataFrame:
    """(keys, n, first_key): rows by a composite key, in which null counts as the empty text, with the least `first` of each."""
    return rows.groupBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys)).agg(F.count("*").alias("n"), F.min(first).alias("first_key"))


def activity(rows: DataFrame, group_by: list[str], time_col: str = "at") -> DataFrame:
    """Counts of activity; group_by: columns, and day, hour or week of time_col."""
    parts = {p: F.date_trunc(p, time_col).alias(p) for p in ("hour", "day", "week")}
    return rows.groupBy(*(parts.get(g, g) for g in group_by)).agg(F.count("*").alias("n"))


def queue_stats(queue: DataFrame, status_col: str = "status") -> DataFrame:
    """(status, n)."""
    return queue.groupBy(F.col(status_col).alias("status")).agg(F.count("*").alias("n"))


def waiting_since(queue: DataFrame, since_col: str = "enqueued_at", by: list[str] | None = None) -> DataFrame:
    """oldest and newest time of waiting rows, by the given columns; one row if there are none to group by."""
    return queue.groupBy(*(by or [])).agg(F.min(since_col).alias("oldest"), F.max(since_col).alias("newest"))


def run_rollup(runs: DataFrame, run: str, running: Column, at: str) -> DataFrame:
    """(run_id, total, running, first_at, last_at)."""
    return runs.groupBy(F.col(run).alias("run_id")).agg(F.count("*").alias("total"), F.count_if(running).alias("running"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def job_rollup(sessions: DataFrame, by: str, score: str, status: Column | None = None) -> DataFrame:
    """(by, n, pass_rate): sessions with a score, of those that are done if status tells, and the mean of their scores to six places."""
    rows = sessions if status is None else sessions.where(status)
    return rows.groupBy(by).agg(F.count(score).alias("n"), F.round(F.avg(score), 6).alias("pass_rate"))


def run_summary(runs: DataFrame, status_col: str, done: list[str], failed: list[str]) -> DataFrame:
    """(total, completed, failed, other, completed_pct, failed_pct) of all runs; one row, with no percentages of no runs."""
    status, n = F.col(status_col), F.count("*")
    share = lambda values: F.round(100 * F.count_if(status.isin(values)) / F.nullif(n, F.lit(0)), 2)
    return runs.agg(n.alias("total"), F.count_if(status.isin(done)).alias("completed"), F.count_if(status.isin(failed)).alias("failed"), F.count_if(~F.coalesce(status.isin(done + failed), F.lit(False))).alias("other"), share(done).alias("completed_pct"), share(failed).alias("failed_pct"))


def source_summary(files: DataFrame, source: str, size: Column, newest: str) -> DataFrame:
    """(source, files, bytes, newest)."""
    return files.groupBy(source).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.max(newest).alias("newest"))


def grouped_shape(groups: DataFrame, keys: list[str]) -> DataFrame:
    """The groups as requests return them: the keys in one struct `key`, the metrics beside it."""
    return groups.select(F.struct(*keys).alias("key"), *(c for c in groups.columns if c not in keys))


def top_counts(rows: DataFrame, by: list[str], value: str, most: int = 8) -> DataFrame:
    """(by, value, n, nth): the most frequent values of each group, ties by value; nulls don't count. Each task keeps as many before the shuffle."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    order = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("n"), value))
    return counts.withColumn("nth", order).where(F.col("nth") <= most)


def dropped_summary(dropped: DataFrame, session_col: str, type_col: str, name_col: str, file_col: str, time_col: str, most: int = 8) -> DataFrame:
    """Per session, of events that compaction left out: numbers of messages and tool calls, first and last time, and the most used tools (name×count) and files as texts."""
    kind = F.col(type_col)
    base = dropped.groupBy(session_col).agg(
        F.count_if(kind == "user_message").alias("user_messages"), F.count_if(kind == "assistant_message").alias("assistant_messages"), F.count_if(kind == "tool_call").alias("tool_calls"), F.min(time_col).alias("first_at"), F.max(time_col).alias("last_at")
    )
    calls = dropped.where(kind == "tool_call")

    def told(value: str, name: str, shown: Column) -> DataFrame:
        best = top_counts(calls, [session_col], value, most)
        return best.groupBy(session_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", shown.alias("shown")))), lambda x: x["shown"]), ", ").alias(name))

    tools = told(name_col, "tools", F.concat(F.col(name_col), F.lit("×"), F.col("n").cast("string")))
    out = base.join(tools, session_col, "left").join(told(file_col, "files", F.col(file_col)), session_col, "left")
    return out.withColumns({"tools": F.coalesce("tools", F.lit("(none)")), "files": F.coalesce("files", F.lit("(none)"))})


def text_tokens(text: Column) -> Column:
    """A quarter of the characters, 1 at least; null: 0."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.char_length(text) / 4))).cast("long")


def event_tokens(text: Column | None = None, output: Column | None = None, arguments: Column | None = None) -> Column:
    """What an event costs: its text, its output, its arguments as JSON (unless empty), and the wrapping."""
    total = F.lit(WRAPPING).cast("long")
    for part in (text, output):
        if part is not None:
            total = total + text_tokens(part)
    if arguments is not None:
        total = total + F.when(arguments == "{}", F.lit(0)).otherwise(text_tokens(arguments))
    return total


def token_totals(events: DataFrame, by: list[str], cost: Column) -> DataFrame:
    """(by, events, tokens)."""
    return events.groupBy(*by).agg(F.count("*").alias("events"), F.sum(cost).alias("tokens"))


def usable_window(model: Column, tool: Column, windows: Mapping[str, int], tools: Mapping[str, int], margin: float = MARGIN) -> Column:
    """Tokens to aim at: the margin of the model's window, else of the tool's, else of UNKNOWN_WINDOW. windows, tools: few, written by hand."""
    known = lambda c, table: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c) if table else F.lit(None).cast("int")
    return F.floor(F.coalesce(known(model, windows), known(tool, tools), F.lit(UNKNOWN_WINDOW)) * F.lit(margin)).cast("long")


def clamped_score(result: Column) -> Column:
    """A verifier's result as a score from 0 to 1: a number as text, or JSON with a field score; anything else is 0."""
    number = F.coalesce(result.try_cast("double"), F.get_json_object(result, "$.score").try_cast("double"), F.lit(0.0))
    return F.when(F.isnan(number), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))
