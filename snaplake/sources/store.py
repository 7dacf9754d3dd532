"""Files of transcripts where tools leave them: what is there, sessions as the files tell them, stored events, message logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.functions.text import file_id

#: Parts of paths that are never read.
EXCLUDED = ["session-env", "auth.json", "config.toml", "shell_snapshots"]


def discovered(spark: SparkSession, folder: str, glob: str = "*.jsonl", excluded: list[str] | None = None) -> DataFrame:
    """(path, modified_at, bytes) of the files below a folder whose names match, but for those with an excluded part in their path. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    parts = F.split("path", "/")
    bad = F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED if excluded is None else excluded)).cast("array<string>"))
    return files.where(~bad).select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"))


def summarised(files: DataFrame, source: Column) -> DataFrame:
    """(source, files, bytes, newest) of discovered files."""
    return files.groupBy(source.alias("source")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("modified_at").alias("newest"))


def catalogued(files: DataFrame, tool: str, lines: DataFrame | None = None) -> DataFrame:
    """(id, tool, path, last_active, event_count, bytes): a session for each discovered file, as its path and state tell.

    lines: (path, n) if lines were counted; without them event_count is null. Of files with one id the one
    changed last stays, ties by path.
    """
    rows = files.select(file_id(F.col("path")).alias("id"), F.lit(tool).alias("tool"), "path", F.col("modified_at").alias("last_active"), "bytes")
    rows = rows.withColumn("event_count", F.lit(None).cast("long")) if lines is None else rows.join(lines.select("path", F.col("n").alias("event_count")), "path", "left")
    last = rows.groupBy("id").agg(F.max(F.struct("last_active", "path", "tool", "event_count", "bytes")).alias("f"))
    return last.select("id", "f.tool", "f.path", "f.last_active", "f.event_count", "f.bytes")


def line_counts(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, n): lines that aren't blank, of each file."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
    return lines.where(F.trim("value") != "").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))


def stored_events(lines: DataFrame, required: dict[str, list[str]], line_col: str = "line", fields: str = "type string, id string, text string, tool_call_id string, name string, output string, timestamp string") -> DataFrame:
    """Stored events of JSON lines, one a row: columns of lines (without the text itself) and the fields.

    A line that is blank or no JSON object, a type that `required` doesn't list and an event that lacks one of
    its type's fields are left out.
    """
    parsed = lines.withColumn("event", F.from_json(F.when(F.trim(line_col).startswith("{"), F.col(line_col)), fields, {"mode": "PERMISSIVE"}))
    event = F.col("event")
    valid = F.lit(False)
    for kind, names in required.items():
        here = event["type"] == kind
        for n in names:
            here = here & event[n].isNotNull()
        valid = valid | here
    rest = [c for c in lines.columns if c != line_col]
    return parsed.where(F.coalesce(valid, F.lit(False))).select(*rest, "event.*")


def unlogged(history: DataFrame, logged: DataFrame, session_col: str = "session", nth_col: str = "nth") -> DataFrame:
    """Messages of a session's history (nth from 0) that its log doesn't have yet; logged: (session, n). A session without a log is new as a whole."""
    known = logged.select(F.col(session_col), F.col("n").alias("logged_count"))
    return history.join(known, session_col, "left").where(F.col(nth_col) >= F.coalesce("logged_count", F.lit(0))).drop("logged_count")


def after_append(logged: DataFrame, added: DataFrame, session_col: str = "session") -> DataFrame:
    """(session, n): the counts once these messages are appended."""
    more = added.groupBy(session_col).agg(F.count("*").alias("n"))
    return logged.select(session_col, "n").unionByName(more).groupBy(session_col).agg(F.sum("n").alias("n"))


def appended(index: DataFrame, rows: DataFrame, removed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """An index log after rows were appended and those with removed keys deleted; the log is a table, and the new one takes its place as a whole."""
    out = index.unionByName(rows, allowMissingColumns=True)
    return out if removed is None else out.join(removed.select(key), key, "left_anti").select(*out.columns)
