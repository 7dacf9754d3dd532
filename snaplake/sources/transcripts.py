"""Transcripts, one JSON row a line, as events: one row for each content block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROW = "type string, uuid string, parentUuid string, sessionId string, cwd string, gitBranch string, version string, timestamp string, message struct<role: string, content: variant>"


def read_lines(spark: SparkSession, path: str, below: str | None = None) -> DataFrame:
    """(file, line_no, line) of the files' lines; blank ones count but are left out, and so is a last line without its end. below: the files below path whose names match this glob.

    Large files are read in blocks by many tasks: lines are numbered within their block, and the blocks of a
    file are counted. Whether a file's last line has its end, the bytes of its lines tell beside its size.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size")]
    reader = spark.read.option("lineSep", "\n") if below is None else spark.read.options(lineSep="\n", recursiveFileLookup="true", pathGlobFilter=below)
    rows = reader.text(path).select(*meta, F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("file", "start").orderBy("at")))
    blocks = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.min("size").alias("size"))
    file = Window.partitionBy("file")
    blocks = blocks.select(
        "file", "start", F.coalesce(F.sum("n").over(file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(file).alias("lines"), (F.sum("bytes").over(file) > F.col("size")).alias("open")
    )
    placed = numbered.drop("size").join(blocks, ["file", "start"]).withColumn("line_no", F.col("before") + F.col("nth"))
    return placed.where("line <> '' and not (open and line_no = lines)").select("file", F.col("line_no").cast("int").alias("line_no"), "line")


def block_events(lines: DataFrame) -> DataFrame:
    """(session_id, file, line_no, block, id, type, role, text, tool_call_id, name, input, is_error, raw, timestamp, parent_id) of block-style rows.

    A row's content is a text or a list of blocks; each block is one event, called id#block from the second
    on. Rows that are no JSON are left out, those of unknown kinds stay as 'opaque', raw is the line itself.
    """
    parsed = lines.select("file", "line_no", F.col("line").alias("raw"), F.from_json("line", _ROW).alias("r")).where(F.try_parse_json("raw").isNotNull())
    content = F.col("r.message.content")
    listed = F.when(F.schema_of_variant(content).startswith("ARRAY"), F.try_variant_get(content, "$", "array<variant>")).otherwise(F.array(content))
    events = parsed.select("file", "line_no", "raw", "r", F.posexplode(F.when(content.isNull(), F.array(F.lit(None).cast("variant"))).otherwise(listed)).alias("block", "b"))
    get = lambda path, kind="string": F.try_variant_get("b", path, kind)
    kind = F.coalesce(get("$.type"), F.when(F.col("b").isNotNull(), "text"))
    role = F.col("r.message.role")
    name = (
        F.when(kind == "tool_use", "tool_call").when(kind == "tool_result", "tool_result").when(kind == "thinking", "assistant_reasoning")
        .when((kind == "text") & (role == "user"), "user_message").when((kind == "text") & (role == "assistant"), "assistant_message")
        .when(F.col("r.type").isin("system", "permission-mode", "attachment", "file-history-snapshot"), "lifecycle").otherwise("opaque")
    )
    base = F.coalesce("r.uuid", F.concat(F.lit("L"), F.col("line_no")))
    text = F.coalesce(get("$.text"), get("$.thinking"), get("$.content"), get("$"))
    return events.select(
        F.col("r.sessionId").alias("session_id"), "file", "line_no", "block", F.when(F.col("block") == 0, base).otherwise(F.concat(base, F.lit("#"), F.col("block"))).alias("id"), name.alias("type"), role.alias("role"),
        F.when(name != "tool_call", text).alias("text"), F.coalesce(get("$.tool_use_id"), F.when(kind == "tool_use", get("$.id"))).alias("tool_call_id"), F.when(kind == "tool_use", get("$.name")).alias("name"),
        F.when(kind == "tool_use", F.to_json(F.try_variant_get("b", "$.input", "variant"))).alias("input"), get("$.is_error", "boolean").alias("is_error"), "raw", F.col("r.timestamp").alias("timestamp"), F.col("r.parentUuid").alias("parent_id"),
    )


def session_starts(lines: DataFrame) -> DataFrame:
    """(file, session_id, cwd, git_branch, version) from the first row of each file."""
    first = lines.groupBy("file").agg(F.min_by("line", "line_no").alias("line"))
    r = first.select("file", F.from_json("line", _ROW).alias("r"))
    return r.select("file", F.col("r.sessionId").alias("session_id"), F.col("r.cwd").alias("cwd"), F.col("r.gitBranch").alias("git_branch"), F.col("r.version").alias("version")).where("coalesce(session_id, cwd, git_branch, version) is not null")


def written_back(events: DataFrame) -> DataFrame:
    """(file, line_no, raw): each row once, as it was read."""
    return events.where("block = 0").select("file", "line_no", "raw")


def calls_with_results(events: DataFrame) -> DataFrame:
    """Each tool call with its result, null if there is none."""
    calls = events.where("type = 'tool_call'").select("session_id", "tool_call_id", "name", "input")
    results = events.where("type = 'tool_result'").select("session_id", "tool_call_id", F.col("text").alias("output"), "is_error")
    return calls.join(results, ["session_id", "tool_call_id"], "left")


def without_repeats(events: DataFrame) -> DataFrame:
    """The first row of each id in a file."""
    w = Window.partitionBy("file", "id").orderBy("line_no", "block")
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
