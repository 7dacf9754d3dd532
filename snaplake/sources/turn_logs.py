"""Row-style transcripts: lines of {type, timestamp, payload}, as events with the state of the session at each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event type by row type, or by row type and payload type. Messages go by their role.
TYPES = {
    "session_meta": "session_start", "turn_context": "turn_start", "compacted": "lifecycle",
    "response_item.function_call": "tool_call", "response_item.function_call_output": "tool_result", "response_item.reasoning": "assistant_reasoning",
    "response_item.custom_tool_call": "tool_call", "response_item.web_search_call": "tool_call", "response_item.tool_search_call": "tool_call",
    "response_item.custom_tool_call_output": "tool_result", "response_item.web_search_call_output": "tool_result", "response_item.tool_search_output": "tool_result",
    "response_item.compacted": "lifecycle",
    "event_msg.user_message": "user_message", "event_msg.agent_message": "assistant_message", "event_msg.agent_reasoning": "assistant_reasoning",
    "event_msg.task_started": "turn_start", "event_msg.task_complete": "turn_end", "event_msg.turn_aborted": "turn_end", "event_msg.token_count": "token_usage",
    "event_msg.exec_command_end": "tool_result", "event_msg.web_search_end": "tool_result", "event_msg.mcp_tool_call_end": "tool_result",
    "event_msg.collab_agent_spawn_end": "tool_call", "event_msg.collab_waiting_end": "tool_result", "event_msg.collab_close_end": "tool_result",
    "event_msg.patch_apply_end": "lifecycle", "event_msg.thread_name_updated": "lifecycle", "event_msg.error": "lifecycle", "event_msg.context_compacted": "lifecycle",
}
#: Image type by the ending of a path; others are PNG.
IMAGES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}

_SUB = "array<struct<suffix: string, type: string, name: string, text: string, media_type: string>>"


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _filled(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(~x.isin("", "{}", "[]"), x) for x in values))


def _flat(content: Column) -> Column:
    """A text, or the texts of a list of blocks, one a line; images as a mark, other blocks as JSON."""
    kind = lambda b: _at(b, "$.type")
    one = lambda b: F.when(kind(b) == "input_image", F.lit("[image]")).otherwise(F.coalesce(_at(b, "$.text"), _at(b, "$")))
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), F.array_join(F.transform(_at(content, "$", "array<variant>"), one), "\n")).otherwise(_at(content, "$"))


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def _milliseconds(p: Column) -> Column:
    """A duration in milliseconds: duration_ms, or duration as seconds (from a million on already milliseconds) or as {secs, nanos}."""
    number, secs = _at(p, "$.duration", "double"), _at(p, "$.duration.secs", "long")
    whole = F.floor(F.when(number < 1e6, number * 1000).otherwise(number))
    parts = secs * 1000 + F.floor(F.coalesce(_at(p, "$.duration.nanos", "long"), F.lit(0)) / 1_000_000)
    return F.coalesce(_at(p, "$.duration_ms", "long"), whole, parts)


def row_events(lines: DataFrame) -> DataFrame:
    """(file, line_no, id, type, layer, role, text, tool_call_id, name, input, is_error, exit_code, turn_id, model, provider, input_tokens,
    output_tokens, cache_read_tokens, total_tokens, media_type, synthesized, raw, block, timestamp, aborted, duration_ms, encrypted_content) of lines (file, line_no, line).

    Model and provider are those in force at a row. A turn whose approval or sandbox policy differs from the
    last one gives an 'operator' event besides, an image of a message an 'attachment'; these are synthesized
    and have no raw. Both layers (response_item, event_msg) stay. Lines that are no JSON objects are left out,
    rows of unknown kinds are 'opaque'. Null columns where a kind has no such value; no lines: no rows.
    """
    v = F.try_parse_json("line")
    rows = lines.select("file", "line_no", F.col("line").alias("raw"), v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    rows = rows.select("file", "line_no", "raw", _at(F.col("v"), "$.type").alias("kind"), _at(F.col("v"), "$.timestamp").alias("timestamp"), F.coalesce(_at(F.col("v"), "$.payload", "variant"), F.parse_json(F.lit("{}"))).alias("p"))
    p, kind = F.col("p"), F.col("kind")
    get = lambda path, to="string": _at(p, path, to)
    turn = kind == "turn_context"
    w = Window.partitionBy("file").orderBy("line_no")
    now, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    approval, sandbox = F.when(turn, get("$.approval_policy")), F.when(turn, get("$.sandbox_policy"))
    rows = rows.select(
        "*",
        F.when(kind.isin("response_item", "event_msg"), F.concat(kind, F.lit("."), F.coalesce(get("$.type"), F.lit("unknown")))).otherwise(kind).alias("key"),
        F.last(F.when(turn, get("$.model")), ignorenulls=True).over(now).alias("model"),
        F.last(F.when(kind == "session_meta", _filled(get("$.model_provider"))), ignorenulls=True).over(now).alias("provider"),
        approval.alias("approval"), F.last(approval, ignorenulls=True).over(before).alias("approval_before"),
        sandbox.alias("sandbox"), F.last(sandbox, ignorenulls=True).over(before).alias("sandbox_before"),
    )
    key = F.col("key")
    message = key == "response_item.message"
    name = F.when(message, F.when(get("$.role").isin("user", "developer", "system"), "user_message").otherwise("assistant_message")).otherwise(F.coalesce(_looked_up(key, TYPES), F.lit("opaque")))
    tool = F.when(name == "tool_result", _filled(
        get("$.formatted_output"), get("$.output"), _flat(_at(p, "$.result.Ok.content", "variant")), get("$.result"), get("$.agent_statuses"),
        get("$.status.completed"), get("$.status.aborted"), get("$.status"), get("$.tools"),
    ))
    text = F.coalesce(F.when(message, _flat(get("$.content", "variant"))), F.when(name == "session_start", F.coalesce(get("$.base_instructions.text"), get("$.base_instructions"))), tool, F.when(key == "response_item.reasoning", _filled(_flat(get("$.summary", "variant")))), F.when(kind == "event_msg", F.coalesce(get("$.message"), get("$.text"))))
    given = F.coalesce(_filled(get("$.input"), get("$.action"), get("$.arguments")), F.lit("{}"))
    parsed = F.try_parse_json(given)
    asked = F.when(parsed.isNull(), F.lit("{}")).when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed)).otherwise(F.concat(F.lit('{"value":'), F.to_json(parsed), F.lit("}")))
    spawn = key == "event_msg.collab_agent_spawn_end"
    spawned = F.to_json(F.struct(get("$.new_agent_nickname").alias("agent_nickname"), get("$.new_agent_role").alias("agent_role"), get("$.new_thread_id").alias("thread_id"), get("$.prompt").alias("prompt")), {"ignoreNullFields": "false"})
    last = _filled(get("$.info.last_token_usage")).isNotNull()
    use = lambda field: F.when(name == "token_usage", F.when(last, get(f"$.info.last_token_usage.{field}", "long")).otherwise(get(f"$.info.total_token_usage.{field}", "long")))
    null = F.lit(None).cast("string")
    sub = lambda suffix, type_, name_, text_, media=null: F.struct(suffix.alias("suffix"), F.lit(type_).alias("type"), name_.alias("name"), text_.alias("text"), media.alias("media_type"))
    none = F.array().cast(_SUB)
    changed = lambda c: F.when((F.col(c) != "") & (F.col(c) != F.col(f"{c}_before")), F.array(sub(F.lit(f"#{c}"), "operator", F.lit(f"{c}_policy"), F.coalesce(_at(F.try_parse_json(c), "$.type"), F.col(c))))).otherwise(none)
    shown = key == "event_msg.user_message"
    inline = F.transform(get("$.images", "array<string>"), lambda x, i: sub(F.concat(F.lit("#img"), i), "attachment", null, x, F.coalesce(F.nullif(F.regexp_extract(x, "^data:([^;]+);", 1), F.lit("")), F.lit("image/png"))))
    ending = lambda x: F.substring_index(F.lower(x), ".", -1)
    linked = F.transform(get("$.local_image_paths", "array<string>"), lambda x, i: sub(F.concat(F.lit("#imgref"), i), "attachment", F.substring_index(x, "/", -1), x, F.coalesce(_looked_up(ending(x), IMAGES), F.lit("image/png"))))
    main = sub(F.lit(""), "", null, null)
    subs = F.concat(F.array(main).cast(_SUB), changed("approval"), changed("sandbox"), *(F.coalesce(F.when(shown, a).cast(_SUB), none) for a in (inline, linked)))
    wide = rows.select(
        "file", "line_no", F.concat(F.lit("L"), F.col("line_no")).alias("row_id"), name.alias("row_type"), F.when(kind.isin("response_item", "event_msg"), kind).alias("layer"), F.when(message, get("$.role")).alias("role"), text.alias("row_text"),
        F.when(name.isin("tool_call", "tool_result"), F.coalesce(_filled(get("$.call_id"), get("$.id")), F.lit(""))).alias("tool_call_id"),
        F.when(spawn, F.concat(F.lit("collab_agent."), F.coalesce(get("$.new_agent_role"), F.lit("agent")))).when(name == "tool_call", F.coalesce(get("$.name"), get("$.type"))).when(name == "lifecycle", F.when(key.endswith("compacted"), "context_compacted").otherwise(get("$.type"))).when(name == "opaque", key).alias("row_name"),
        F.when(spawn, spawned).when(name == "tool_call", asked).alias("input"),
        F.when(key == "event_msg.mcp_tool_call_end", _filled(get("$.result.Err"), get("$.result.err")).isNotNull()).alias("is_error"),
        F.when(name == "tool_result", get("$.exit_code", "long")).alias("exit_code"), F.when(name.isin("turn_start", "turn_end"), get("$.turn_id")).alias("turn_id"),
        F.when(turn, get("$.model")).when(name == "assistant_message", F.col("model")).alias("model"), F.when(name == "token_usage", F.col("provider")).alias("provider"),
        use("input_tokens").alias("input_tokens"), use("output_tokens").alias("output_tokens"), use("cached_input_tokens").alias("cache_read_tokens"), use("total_tokens").alias("total_tokens"), "raw", "timestamp",
        F.when(name == "turn_end", key == "event_msg.turn_aborted").alias("aborted"), F.when(name == "tool_result", _milliseconds(p)).alias("duration_ms"), F.when(name == "assistant_reasoning", get("$.encrypted_content")).alias("encrypted_content"), F.posexplode(subs).alias("block", "s"),
    )
    own = F.col("s.suffix") == ""
    keep = lambda c: F.when(own, F.col(c)).alias(c)
    return wide.select(
        "file", "line_no", F.concat("row_id", "s.suffix").alias("id"), F.when(own, F.col("row_type")).otherwise(F.col("s.type")).alias("type"), keep("layer"), keep("role"), F.when(own, F.col("row_text")).otherwise(F.col("s.text")).alias("text"), keep("tool_call_id"),
        F.when(own, F.col("row_name")).otherwise(F.col("s.name")).alias("name"), *map(keep, ("input", "is_error", "exit_code", "turn_id", "model", "provider", "input_tokens", "output_tokens", "cache_read_tokens", "total_tokens")), F.col("s.media_type").alias("media_type"), (~own).alias("synthesized"), keep("raw"), "block", "timestamp", *map(keep, ("aborted", "duration_ms", "encrypted_content")),
    )
