"""Transcripts written back: as they were read, and in the other style."""

import json

import pytest
from pyspark.sql import functions as F

from snaplake.sources import rewriting, transcripts, turn_logs

LINES = "file string, line_no int, line string"


def frame(spark, rows):
    return spark.createDataFrame([("f", i, json.dumps(r)) for i, r in enumerate(rows, 1)], LINES)


BLOCKS = [
    {"type": "user", "uuid": "u1", "sessionId": "s", "cwd": "/x/.y", "gitBranch": "b", "version": "2", "timestamp": "t1", "message": {"role": "user", "content": "héllo \"q\""}},
    {"type": "assistant", "uuid": "u2", "sessionId": "s", "timestamp": "t2", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "id": "c1", "name": "ls", "input": {"a": 1}}]}},
    {"type": "user", "uuid": "u3", "sessionId": "s", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "out", "is_error": True}]}},
    {"type": "system", "uuid": "u4", "sessionId": "s"},
]
ROWS = [
    {"timestamp": "t0", "type": "session_meta", "payload": {"id": "z", "cwd": "/w", "cli_version": "9", "base_instructions": {"text": "be kind"}}},
    {"timestamp": "t1", "type": "turn_context", "payload": {"turn_id": "k", "model": "m"}},
    {"timestamp": "t2", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "ask"}]}},
    {"timestamp": "t3", "type": "response_item", "payload": {"type": "function_call", "call_id": "c", "name": "ls", "arguments": "{\"a\": 1}"}},
    {"timestamp": "t4", "type": "event_msg", "payload": {"type": "exec_command_end", "call_id": "c", "output": "files", "duration": {"secs": 2, "nanos": 5000000}}},
    {"timestamp": "t5", "type": "event_msg", "payload": {"type": "turn_aborted", "turn_id": "k"}},
    {"timestamp": "t6", "type": "event_msg", "payload": {"type": "user_message", "message": "look", "images": ["data:image/gif;base64,AA"]}},
]


def test_rows_as_read(spark):
    for rows, read in ((BLOCKS, transcripts.block_events), (ROWS, turn_logs.row_events)):
        lines = frame(spark, [*rows, rows[0]] if read is transcripts.block_events else rows)
        back = rewriting.rows_as_read(read(lines)).orderBy("line_no").collect()
        assert [json.loads(r.line) for r in back] == rows  # a repeated id is written once
        assert rewriting.rows_as_read(read(lines.where("false"))).count() == 0


def test_blocks_to_rows(spark):
    out = rewriting.converted(frame(spark, BLOCKS), "rows", "blocks", F.lit("new")).orderBy("line_no", "block").collect()
    got = [json.loads(r.line) for r in out]
    assert [(r["type"], r["payload"].get("type")) for r in got] == [("session_meta", None), ("response_item", "message"), ("response_item", "reasoning"), ("response_item", "message"), ("response_item", "function_call"), ("response_item", "function_call_output"), ("event_msg", "thread_name_updated")]
    assert got[0]["payload"]["id"] == "new" and got[0]["payload"]["cwd"] == "/x/.y" and got[0]["payload"]["cli_version"] == "2" and got[0]["payload"]["base_instructions"]["text"]
    assert got[1] == {"timestamp": "t1", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "héllo \"q\""}]}}
    assert got[2]["payload"] == {"type": "reasoning", "summary": [{"type": "summary_text", "text": "hm"}], "encrypted_content": None}
    assert json.loads(got[4]["payload"]["arguments"]) == {"a": 1} and got[5]["payload"]["output"] == "out"
    again = turn_logs.row_events(spark.createDataFrame([("f", i, r.line) for i, r in enumerate(out)], LINES)).orderBy("line_no")
    assert [r.type for r in again.collect()] == ["session_start", "user_message", "assistant_reasoning", "assistant_message", "tool_call", "tool_result", "lifecycle"]


def test_rows_to_blocks(spark):
    lines = frame(spark, ROWS)
    out = rewriting.converted(lines, "blocks", "rows").orderBy("line_no", "block").collect()
    got = [json.loads(r.line) for r in out]
    assert len({r.session for r in out}) == 1 and len(out[0].session) == 36 and all(r["sessionId"] == out[0].session and r["cwd"] == "/w" and r["version"] == "9" for r in got)
    assert [r["type"] for r in got] == ["system", "system", "user", "assistant", "user", "system", "user", "system"]
    assert got[0]["content"] == "[converted from rows] cwd=/w agent=9" and got[1]["content"] == "[converted from rows] turn_start"
    assert got[2]["message"] == {"role": "user", "content": "ask"} and got[3]["message"]["content"] == [{"type": "tool_use", "id": "c", "name": "ls", "input": {"a": 1}}]
    assert got[4]["message"]["content"] == [{"type": "tool_result", "tool_use_id": "c", "content": "files", "is_error": False}]
    again = transcripts.block_events(spark.createDataFrame([("f", i, r.line) for i, r in enumerate(out)], LINES)).orderBy("line_no")
    assert [r.type for r in again.collect()] == ["lifecycle", "lifecycle", "user_message", "tool_call", "tool_result", "lifecycle", "user_message", "lifecycle"]
    events = {r.id: r for r in turn_logs.row_events(lines).collect()}
    assert (events["L5"].duration_ms, events["L6"].aborted, events["L1"].timestamp) == (2005, True, "t0")


def test_paths_and_unknown_styles(spark):
    row = spark.range(1).select(rewriting.suggested_path("blocks", F.lit("s"), F.lit("/U/.c d")).alias("b"), rewriting.suggested_path("rows", F.lit("s"), F.lit("/"), F.lit("2026-01-02 03:04:05").cast("timestamp")).alias("r")).first()
    assert row.b == ".claude/projects/-U--c-d/s.jsonl" and row.r == ".codex/sessions/2026/01/02/rollout-2026-01-02T03-04-05-s.jsonl"
    with pytest.raises(ValueError):
        rewriting.converted(frame(spark, BLOCKS), "x", "y")
