"""Uploads, task files, file checks, queue states, long forks and text helpers."""

import gzip
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snaplake.functions import text as T
from snaplake.operators import filters, sessions, sync
from snaplake.operators.files import expect_files
from snaplake.sources import uploads
from snaplake.sources.tasks import read_tasks, write_tasks
from snaplake.sources.uploads import payloads


def test_payloads(spark):
    rows = [("a.jsonl", b'{"a":1}\n{"cut'), ("b.jsonl", b"no end"), ("c.txt", b"x\ny"), ("d.jsonl", b"AKIA" + b"A" * 16 + b"\n"), ("e", b"\xff" * 3), ("f", None), ("g.txt", b"z" * 5000)]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r for r in payloads(files).collect()}
    plain = {p: gzip.decompress(r.content) if r.codec == "gzip" else bytes(r.content) for p, r in got.items()}
    assert plain == {"a.jsonl": b'{"a":1}\n', "b.jsonl": b"no end", "c.txt": b"x\ny", "d.jsonl": b"[REDACTED_AWS_KEY]\n", "e": "�".encode() * 3, "f": b"", "g.txt": b"z" * 5000}
    assert got["g.txt"].codec == "gzip" and got["g.txt"].stored_bytes < 100 and got["c.txt"].codec == "raw" and got["g.txt"].raw_bytes == 5000
    assert {r.codec for r in payloads(files, "gzip").collect()} == {"gzip"} and payloads(files.where("false")).count() == 0
    with pytest.raises(ValueError):
        payloads(files, "zip")


def test_tasks_round_trip(spark, tmp_path):
    tasks = [
        {"key": "k1", "prompt": "p", "env_key": "e", "verifier": {"code": "c", "sha256": "s", "verifier_id": "v"}, "metadata": {"verifier_runtime_version": "2", "x": [1]}},
        {"id": "k2", "prompt": "q", "env_id": "f", "verifier_code": "d", "metadata": {"verifier": {"verifier_id": "w"}}, "version": "1"},
        {"key": "k3", "prompt": "r"},
    ]
    for name, body in (("list", json.dumps(tasks)), ("object", json.dumps({"tasks": tasks}, indent=1)), ("lines", "\n".join(map(json.dumps, tasks)) + "\n")):
        (tmp_path / name).write_text(body)
        got = {r.key: r for r in read_tasks(spark, str(tmp_path / name)).collect()}
        assert [(r.env_id, r.verifier_func, r.verifier_id, r.verifier_sha, r.verifier_runtime_version) for r in (got["k1"], got["k2"], got["k3"])] == [("e", "c", "v", "s", "2"), ("f", "d", "w", "", None), (None, None, "k3", "", None)]
    read = read_tasks(spark, str(tmp_path / "list"))
    assert [r.key for r in read_tasks(spark, str(tmp_path / "list"), env_id="f", version=None).collect()] == ["k2"]
    write_tasks(read, str(tmp_path / "out"))
    again = read_tasks(spark, str(tmp_path / "out"))
    as_text = lambda frame: sorted(r[0] for r in frame.select(F.to_json(F.struct("*"))).collect())
    assert as_text(again) == as_text(read)


def test_file_checks(spark):
    changed = spark.createDataFrame([("a", "text", "t", 4), ("b", None, "t", 1), ("c", "x", None, None)], "path string, content string, file_type string, size long")
    specs = [{"path": "a", "content": "text", "file_type": ..., "size": 4}, {"path": "b", "content_contains": "q"}, {"path": "d"}]
    assert {(r.path, r.problem) for r in expect_files(changed, specs).collect()} == {("b", "unavailable"), ("c", "unexpected"), ("d", "missing")}
    assert {(r.path, r.problem) for r in expect_files(changed, [{"path": "a", "content": "no", "content_contains": "z", "size": 5}, {"path": "b"}, {"path": "c", "file_type": "t"}]).collect()} == {("a", "content"), ("a", "content_contains"), ("a", "size"), ("c", "file_type")}
    assert expect_files(changed, []).where("problem = 'unexpected'").count() == 3 and expect_files(changed.where("false"), []).count() == 0
    with pytest.raises(ValueError):
        expect_files(changed, [{"size": 1}])


def test_queue_states(spark):
    stamp = lambda day: f"timestamp'2024-01-{day:02d}'"
    row = lambda p, s, status, day: f"select '{p}' path, '{s}' sha256, '{status}' status, 3 attempts, 'e' last_error, {stamp(day)} next_attempt_at, {stamp(day)} enqueued_at, {stamp(day)} updated_at"
    queue = spark.sql(" union all ".join([row("p", "1", "failed", 1), row("p", "2", "in_flight", 2), row("p", "3", "pending", 2), row("q", "1", "done", 1)]))
    now = F.lit("2024-01-03").cast("timestamp")
    items = spark.createDataFrame([("p", "1"), ("p", "2"), ("z", "9"), ("z", "9")], "path string, sha256 string")
    states = lambda q: sorted((r.path, r.sha256, r.status) for r in q.collect())
    assert states(sync.enqueued(queue, items, now)) == sorted([*states(queue), ("z", "9", "pending")])
    again = sync.requeued(queue, items, now)
    assert states(again) == [("p", "1", "pending"), ("p", "2", "pending"), ("p", "3", "pending"), ("q", "1", "done"), ("z", "9", "pending")]
    assert again.where("path = 'p' and attempts = 0 and last_error is null").count() == 2 and again.columns == queue.columns
    assert states(sync.after_success(queue, items.where("sha256 = '2'"), now)) == [("p", "2", "done"), ("p", "3", "pending"), ("q", "1", "done")]
    assert states(sync.reset_failed(queue, now))[0] == ("p", "1", "pending") and sync.reset_failed(queue, now).where("attempts = 0").count() == 1
    assert states(sync.released(queue, now))[1] == ("p", "2", "pending") and states(sync.released(queue, now, "2 days"))[1] == ("p", "2", "in_flight")
    assert len(states(sync.without_old_done(queue, now))) == 3
    files = spark.createDataFrame([("a", 1, 2, b"x"), ("b", 1, 2, b"y")], "path string, mtime long, size long, content binary")
    known = spark.createDataFrame([("a", 1, 2, "kept"), ("gone", 1, 1, "x")], "path string, mtime long, size long, sha256 string")
    got = {r.path: r.sha256 for r in sync.hashes(files, known).collect()}
    assert got["a"] == "kept" and len(got["b"]) == 64 and len(got) == 2


def test_long_forks_and_cycles(spark):
    rows = [(i, i - 1 if i else None, 100 + i) for i in range(150)] + [(1000, 1001, 1), (1001, 1002, 2), (1002, 1000, 3), (1003, 1000, 4), (2000, 2000, 5)]
    got = {(r.id, r.ancestor): (r.depth, r.cap) for r in sessions.ancestors(spark.createDataFrame(rows, "id long, forked_from long, fork_point int")).collect()}
    parent = {i: (p, c) for i, p, c in rows}
    expected = {}
    for i in parent:
        at, depth, cap = i, 0, None
        while at in parent and (i, at) not in expected:
            expected[i, at] = (depth, cap)
            (at, cap), depth = parent[at], depth + 1
    assert got == expected


def test_texts(spark):
    now = F.lit("2026-01-31 00:00:00").cast("timestamp")
    ages = ["2026-01-30T23:59:55Z", "2026-01-30T22:00:00+00:00", "2026-01-29T00:00:00Z", "2025-01-01T00:00:00Z", "2027-01-01T00:00:00Z", "not a time at all", "", None]
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a string").orderBy("i")
    assert [r[0] for r in frame.select(T.age(F.col("a"), now)).collect()] == ["5s ago", "2h ago", "2d ago", "2025-01-01", "future", "not a time at ", "", ""]
    row = spark.range(1).select(
        T.short_folder(F.lit("/U/me/repo//")).alias("a"), T.short_folder(F.lit("/")).alias("b"), T.short_title(F.lit(" x\n\ty " + "z" * 80)).alias("c"), T.levels(F.create_map(F.lit(1), F.lit("low"), F.lit(3), F.lit("high")), F.lit("d"), F.lit("n")).alias("d"),
        T.levels(F.lit(None).cast("map<int,string>"), F.lit(None).cast("string"), F.lit("n")).alias("e"), T.score_band(F.lit(0.5)).alias("f"), T.looks_like_uuid(F.lit("0a0a0a0a-1111-2222-3333-444444444444")).alias("g"), T.contains_number(F.lit("has 1,234.5"), F.lit("1234.50")).alias("h"), T.contains_number(F.lit("1"), F.lit("x")).alias("i"),
    ).first()
    assert (row.a, row.b, row.d, row.e, row.f, row.g, row.h, row.i) == ("repo", "?", "- 3 points: high\n- 1 points: low\nd", "n", "fair", True, True, False)
    assert len(row.c) == 60 and row.c.startswith("x y z") and row.c.endswith("…")
    paths = spark.createDataFrame([("a/1-id7.jsonl",), ("a/id7-more.jsonl",), ("x/id7.jsonl",), ("b/c.txt",)], "p string")
    assert [r[0] for r in paths.select(filters.blocked_path(F.col("p"), [], ["b/*"], ["id7"])).collect()] == [True, False, True, True]


def test_payloads_are_made_some_at_a_time(spark, monkeypatch):
    """A task holds a slice of what comes to it, packed and unpacked; contents, empty and missing ones too, are the same."""
    raw = [b"x" * 3_000_000] * 4 + [None, b""] + [bytes([i % 251]) * 10 for i in range(1_200)]
    batch = pa.record_batch([pa.array([str(i) for i in range(len(raw))]), pa.array(raw, pa.binary())], names=["path", "raw"])
    made = list(uploads._compressed("auto")([batch.slice(0, 0), batch]))
    assert [x for b in made for x in b.column("raw_bytes").to_pylist()] == [len(x or b"") for x in raw]
    assert max(b.num_rows for b in made) <= uploads.ROWS and max(sum(b.column("raw_bytes").to_pylist()) for b in made) <= uploads.BYTES
    monkeypatch.setattr(uploads, "BYTES", 1_000)
    stored = spark.createDataFrame([("a", gzip.compress(b"y" * 5000), "gzip"), ("b", None, "raw"), ("c", b"z" * 3000, "raw"), ("d", gzip.compress(b"w"), None)], "path string, content binary, codec string").coalesce(1)
    assert {r.path: r.content and bytes(r.content) for r in uploads.unpacked(stored).collect()} == {"a": b"y" * 5000, "b": None, "c": b"z" * 3000, "d": b"w"}
