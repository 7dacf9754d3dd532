"""Events written back as transcripts: in their own style as they were read, or in the other style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.sources.transcripts import block_events, session_starts
from snaplake.sources.turn_logs import row_events

#: What readers of either style demand in rows that were never theirs.
NO_ID, NO_VERSION, NO_FOLDER = "00000000-0000-0000-0000-000000000000", "0.0.0-converted", "/tmp"
ORIGINATOR, PROVIDER, INSTRUCTIONS = "codex_cli_rs", "openai", "You are an assistant."


def _json(**fields: Column) -> Column:
    """One JSON object with the fields in this order, nulls written."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"})


def _known(columns: list[str], name: str, kind: str = "string") -> Column:
    return F.col(name) if name in columns else F.lit(None).cast(kind)


def _or(c: Column, other: str = "") -> Column:
    """c, or the other text where it is null or empty."""
    return F.when(c != "", c).otherwise(F.lit(other))


def rows_as_read(events: DataFrame) -> DataFrame:
    """(file, line_no, line): each row of either style once, as it was read.

    Further blocks of a row and synthesized events have no row of their own; of rows with equal ids in a
    file the first is kept. Null raw: left out. No events: no rows.
    """
    own = events.where("raw is not null and not contains(id, '#')")
    first = own.groupBy("file", "id").agg(F.min(F.struct("line_no", "raw")).alias("m"))
    return first.select("file", "m.line_no", F.col("m.raw").alias("line"))


def block_line(columns: list[str], origin: str) -> Column:
    """An event with these columns as a block-style row.

    `session`, `cwd`, `git_branch` and `version` are those of its file (contexts). Kinds that the style
    lacks become system rows that say what they were. Null texts: empty ones; null inputs: {}.
    """
    kind, text, known = F.col("type"), F.coalesce("text", F.lit("")), lambda n, k="string": _known(columns, n, k)
    call, name = F.coalesce("tool_call_id", F.lit("")), F.coalesce(known("name"), F.lit(""))
    base = {
        "uuid": F.coalesce("id", "session", F.lit(NO_ID)), "parentUuid": known("parent_id"), "timestamp": F.coalesce(known("timestamp"), F.lit("")), "sessionId": F.coalesce("session", F.lit(NO_ID)),
        "cwd": _or(F.col("cwd"), NO_FOLDER), "gitBranch": _or(F.col("git_branch")), "version": _or(F.col("version"), NO_VERSION), "entrypoint": F.lit("converted"), "isSidechain": F.lit(False), "userType": F.lit("external"),
    }
    said = lambda role, content: _json(**base, type=F.lit(role), message=F.struct(F.lit(role).alias("role"), content.alias("content")))
    block = lambda **fields: F.array(F.struct(*(c.alias(n) for n, c in fields.items())))
    asked = F.coalesce(F.try_parse_json("input"), F.parse_json(F.lit("{}")))
    about = F.when(kind == "session_start", F.concat(F.lit("cwd="), F.coalesce("cwd", F.lit("None")), F.lit(" agent="), F.coalesce("version", F.lit("None")))).when(kind == "lifecycle", name).otherwise(kind)
    return (
        F.when(kind == "user_message", said("user", text))
        .when(kind == "assistant_message", said("assistant", block(type=F.lit("text"), text=text)))
        .when(kind == "assistant_reasoning", said("assistant", block(type=F.lit("thinking"), thinking=text)))
        .when(kind == "tool_call", said("assistant", block(type=F.lit("tool_use"), id=call, name=name, input=asked)))
        .when(kind == "tool_result", said("user", block(type=F.lit("tool_result"), tool_use_id=call, content=text, is_error=F.coalesce(known("is_error", "boolean"), F.lit(False)))))
        .otherwise(_json(**base, type=F.lit("system"), content=F.concat(F.lit(f"[converted from {origin}] "), about)))
    )


def row_line(columns: list[str], origin: str) -> Column:
    """An event with these columns as a row-style line of the layer that replays read.

    `session`, `cwd` and `version` are those of its file (contexts). Kinds that the style lacks become
    rows that say what they were. Null texts: empty ones; a null reasoning has no summary; null inputs: {}.
    """
    kind, known = F.col("type"), lambda n, k="string": _known(columns, n, k)
    text, call, when = F.coalesce("text", F.lit("")), F.coalesce("tool_call_id", F.lit("")), F.coalesce(known("timestamp"), F.lit(""))
    row = lambda layer, **fields: _json(timestamp=when, type=F.lit(layer), payload=F.struct(*(c.alias(n) for n, c in fields.items())))
    listed = lambda label: F.array(F.struct(F.lit(label).alias("type"), text.alias("text")))
    turn = F.coalesce(known("turn_id"), F.col("id"), F.lit(""))
    counts = [known(here, "long").alias(there) for here, there in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_tokens", "cached_input_tokens"), ("total_tokens", "total_tokens"))]
    summary = F.when(text != "", listed("summary_text")).otherwise(F.slice(listed("summary_text"), 1, 0))
    head = dict(id=F.coalesce("session", "id", F.lit("")), timestamp=when, cwd=_or(F.col("cwd"), NO_FOLDER), originator=F.lit(ORIGINATOR), cli_version=_or(F.col("version"), "0.0.0"), source=F.lit("cli"), model_provider=F.lit(PROVIDER), base_instructions=F.struct(_or(F.col("text"), INSTRUCTIONS).alias("text")))
    return (
        F.when(kind == "user_message", row("response_item", type=F.lit("message"), role=F.lit("user"), content=listed("input_text")))
        .when(kind == "assistant_message", row("response_item", type=F.lit("message"), role=F.lit("assistant"), content=listed("output_text")))
        .when(kind == "assistant_reasoning", row("response_item", type=F.lit("reasoning"), summary=summary, encrypted_content=known("encrypted_content")))
        .when(kind == "tool_call", row("response_item", type=F.lit("function_call"), call_id=call, name=F.coalesce(known("name"), F.lit("")), arguments=_or(known("input"), "{}")))
        .when(kind == "tool_result", row("response_item", type=F.lit("function_call_output"), call_id=call, output=text))
        .when(kind == "session_start", row("session_meta", **head))
        .when(kind == "turn_start", row("turn_context", turn_id=turn, cwd=F.col("cwd"), model=known("model")))
        .when((kind == "turn_end") & F.coalesce(known("aborted", "boolean"), F.lit(False)), row("event_msg", type=F.lit("turn_aborted"), turn_id=turn))
        .when(kind == "turn_end", row("event_msg", type=F.lit("task_complete"), turn_id=turn))
        .when(kind == "token_usage", row("event_msg", type=F.lit("token_count"), info=F.struct(F.struct(*counts).alias("last_token_usage"))))
        .otherwise(row("event_msg", type=F.lit("thread_name_updated"), thread_name=F.concat(F.lit(f"[converted from {origin}] "), F.coalesce(known("name"), kind))))
    )


def contexts(events: DataFrame, session: Column | None = None) -> DataFrame:
    """(file, session, cwd, version, git_branch): of each file the first folder, version and branch that its rows name.

    session: the id that converted rows carry; by default a digest of the file's name in the form of a UUID,
    so that a task that is run again writes the same rows.
    """
    at = lambda *paths: F.coalesce(*(F.nullif(F.get_json_object("raw", p), F.lit("")) for p in paths))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    found = events.groupBy("file").agg(first(at("$.cwd", "$.payload.cwd")).alias("cwd"), first(at("$.version", "$.payload.cli_version")).alias("version"), first(at("$.gitBranch")).alias("git_branch"))
    return found.withColumn("session", session if session is not None else F.regexp_replace(F.md5("file"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def converted(lines: DataFrame, to: str, origin: str, session: Column | None = None) -> DataFrame:
    """(file, line_no, block, session, line) of transcript lines (file, line_no, line) in the other style.

    to: "rows" for block-style lines, with a session row at the head of each file that tells anything of its
    session; "blocks" for row-style lines. `block` orders the lines that come of one. No lines: no rows.
    """
    if to == "rows":
        heads = session_starts(lines).select("file", F.lit(0).alias("line_no"), F.lit(0).alias("block"), F.lit("session_start").alias("type"))
        events = block_events(lines)
        joined = events.unionByName(heads, allowMissingColumns=True).join(contexts(events, session), "file")
        line = row_line(joined.columns, origin)
    elif to == "blocks":
        events = row_events(lines)
        joined = events.join(contexts(events, session), "file")
        line = block_line(joined.columns, origin)
    else:
        raise ValueError(f"no style {to}")
    return joined.select("file", "line_no", "block", "session", line.alias("line"))


def suggested_path(style: str, session: Column, cwd: Column, started: Column | None = None) -> Column:
    """Where a tool of the style ("blocks" or "rows") looks for a session, below the home folder."""
    if style == "blocks":
        return F.concat(F.lit(".claude/projects/"), F.regexp_replace(cwd, "[^a-zA-Z0-9_-]", "-"), F.lit("/"), session, F.lit(".jsonl"))
    if style == "rows" and started is not None:
        return F.concat(F.lit(".codex/sessions/"), F.date_format(started, "yyyy/MM/dd"), F.lit("/rollout-"), F.date_format(started, "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-"), session, F.lit(".jsonl"))
    raise ValueError(f"no style {style}, or no time for it")
