"""Builder, diffs, specs, transcripts and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from snaplake.catalog import Snapshot
from snaplake.functions import text as T
from snaplake.operators import diff, filters, invariants, search, sessions, sync
from snaplake.sources import transcripts, turn_logs
from snaplake.streaming import tail

USERS = "id int, name string, email string, age int"


@pytest.fixture(scope="module")
def db(spark):
    users = spark.createDataFrame([(1, "Alice", "a@x.com", 30), (2, "Bob", "b@x.com", 25), (3, "ÄB_C", None, None)], USERS)
    orders = spark.createDataFrame([(10, 1, 5.0), (11, 1, 7.5), (12, 2, 1.0)], "oid int, user_id int, amount double")
    return Snapshot(spark, {"users": users, "orders": orders}, {"users": ["id"], "orders": ["oid"]})


def test_builder(db):
    users = db.table("users")
    assert users.eq("name", "Alice").first()["age"] == 30
    assert [r["id"] for r in users.sort("age", desc=True).all()] == [1, 2, 3] and [r["id"] for r in users.sort("age").all()] == [3, 2, 1]
    assert users.ilike("name", "%B%").count() == 2 and users.ilike("name", "äb%").count() == 0 and users.ilike("name", "a%").count() == 1
    assert users.in_("id", []).count() == 0 and users.not_in("age", []).count() == 3 and users.not_in("age", [30]).count() == 1
    assert users.eq("email", None).count() == 0 and users.where(email=None).count() == 1
    assert users.limit(1).count() == 3 and len(users.limit(1).all()) == 1
    joined = db.table("orders").join("users", {"user_id": "id"}).gt("amount", 2).select("oid", "name")
    assert [tuple(r.values()) for r in joined.sort("oid").all()] == [(10, "Alice"), (11, "Alice")]
    users.eq("id", 1).assert_exists().assert_eq("name", "Alice").assert_count(eq=1)
    with pytest.raises(AssertionError):
        users.assert_none()
    with pytest.raises(ValueError):
        users.all(most=2)
    assert db.describe().where("is_key").count() == 2
    assert db.sql("select name from users where id = :id", {"id": 2}).first()[0] == "Bob"


def changed(spark, db):
    rows = [(1, "Alice", "a@x.com", 31), (3, "ÄB_C", None, None), (4, "Dan", "d@x.com", 1)]
    return diff.snapshot_changes(db, db.replace(users=spark.createDataFrame(rows, USERS)))


def test_changes_and_specs(spark, db):
    changes = changed(spark, db)
    assert sorted((r.change_type, r.row_id, r.field) for r in changes.collect()) == [("delete", "2", None), ("insert", "4", None), ("modify", "1", "age")]
    good = [
        {"table": "users", "pk": 1, "type": "modify", "resulting_fields": [("age", 31)], "no_other_changes": True},
        {"table": "users", "pk": 2, "type": "delete", "fields": [("id", 2), ("name", "Bob"), ("email", ...), ("age", 25)]},
        {"table": "users", "pk": 4, "type": "insert", "fields": [("id", 4), ("name", "Dan"), ("email", "d@x.com"), ("age", ...)]},
    ]
    assert invariants.expect_only(changes, good).count() == 0 and invariants.expect_exactly(changes, good).count() == 0
    wrong = [{**good[0], "resulting_fields": [("age", 32)]}, {**good[1], "pk": 3}, {**good[2], "fields": good[2]["fields"][:3]}]
    assert {(r.row_id, r.problem) for r in invariants.expect_exactly(changes, wrong).collect()} == {("1", "value"), ("2", "unexpected"), ("3", "missing"), ("4", "field")}
    assert [tuple(r)[1:] for r in invariants.near_matches(changes, wrong).collect()] == [("delete", "3", "2")]
    old = [{"table": "users", "pk": 1, "field": "age", "after": 31}, {"table": "users", "pk": 2, "field": None, "after": "__removed__"}, {"table": "users", "pk": 4, "field": None, "after": "__added__"}]
    assert invariants.expect_only(changes, old).count() == 0
    assert "unexpected" in invariants.report(invariants.expect_only(changes, old[:2]))
    assert invariants.expect(changes, forbid=[{"table": "users"}]).count() == 2
    with pytest.raises(ValueError):
        invariants.expect_only(changes, [{"table": "users", "pk": 1, "type": "modify", "resulting_fields": [("age", 1)]}])
    assert invariants.expect_only(changes, []).where("problem <> 'unexpected'").count() == 0
    with pytest.raises(ValueError):
        diff.check_keys(db.frame("orders"), ["user_id"])


def test_null_values_in_specs(spark, db):
    changes = diff.table_changes(db.frame("users"), db.frame("users").withColumn("email", F.when(F.col("id") == 2, None).otherwise(F.col("email"))), ["id"], "users")
    spec = {"table": "users", "pk": 2, "type": "modify", "no_other_changes": True}
    assert invariants.expect_only(changes, [{**spec, "resulting_fields": [("email", None)]}]).count() == 0
    assert invariants.expect_only(changes, [{**spec, "resulting_fields": [("email", "x")]}]).count() == 1
    assert invariants.expect_only(changes, [{**spec, "resulting_fields": [("email", ...)]}]).count() == 0


def test_scrubbing_keeps_order_and_lines(spark):
    text = "k AKIA" + "A" * 16 + "\nSOME_TOKEN=" + "z" * 30 + "\nBearer " + "t" * 25 + "\n/home/me/x\n-----BEGIN RSA PRIVATE KEY-----\nab\n-----END RSA PRIVATE KEY-----"
    row = spark.createDataFrame([(text,)], "t string").select(T.scrub(F.col("t")).alias("s"), T.scrub_counts(F.col("t")).alias("c")).first()
    assert row.s == "k [REDACTED_AWS_KEY]\nSOME_TOKEN=[REDACTED]\nBearer [REDACTED_TOKEN]\n/home/[user]/x\n[REDACTED_PRIVATE_KEY]"
    assert {r.rule for r in row.c} == {"aws_access_key_id", "env_assignment_long_value", "bearer_token", "home_path_linux", "private_key_block"}
    urls = spark.createDataFrame([("git@Host.org:A/b.git",), ("https://u:p@host.org/a/b/",), ("host.org/a/b",)], "u string")
    assert {r[0] for r in urls.select(T.repository(F.col("u"))).collect()} == {"host.org/a/b"}
    assert [r[0] for r in urls.select(filters.host_allowed(F.col("u"), ["host.org"])).collect()] == [False, True, False]


def test_cursor_round_trip_and_cycles(spark):
    assert sessions.cursor_place(sessions.cursor_of("2026-04-30T00:00:00Z", "abc12345")) == ("2026-04-30T00:00:00Z", "abc12345")
    rows = spark.createDataFrame([("a", None, None), ("b", "a", 3), ("c", "gone", 1), ("x", "y", 1), ("y", "x", 1)], "id string, forked_from string, fork_point int")
    chains = sessions.ancestors(rows)
    assert sorted((r.id, r.ancestor) for r in chains.where("depth > 0").collect()) == [("b", "a"), ("x", "y"), ("y", "x")]
    events = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(2)], "sid string, seq int")
    assert sessions.replay(chains, events, "sid", "seq").where("id = 'b'").count() == 5


def test_transcripts_round_trip(spark, tmp_path):
    lines = [
        json.dumps({"type": "user", "uuid": "u1", "sessionId": "s", "cwd": "/x", "message": {"role": "user", "content": "hello"}}),
        "not json",
        json.dumps({"type": "assistant", "uuid": "u2", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "id": "t1", "name": "ls", "input": {"a": 1}}]}}),
        json.dumps({"type": "user", "sessionId": "s", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "out", "is_error": False}]}}),
        json.dumps({"type": "system", "uuid": "u4", "sessionId": "s"}),
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + '\n{"type": "user", "cut')
    read = transcripts.read_lines(spark, str(tmp_path / "a.jsonl"))
    events = transcripts.block_events(read).orderBy("line_no", "block").collect()
    assert [(r.id, r.type, r.text) for r in events] == [("u1", "user_message", "hello"), ("u2", "assistant_reasoning", "hm"), ("u2#1", "assistant_message", "hi"), ("u2#2", "tool_call", None), ("L4", "tool_result", "out"), ("u4", "lifecycle", None)]
    frame = transcripts.block_events(read)
    assert [r.raw for r in transcripts.written_back(frame).orderBy("line_no").collect()] == [lines[0], *lines[2:]]
    call = transcripts.calls_with_results(frame).first()
    assert (call.name, call.input, call.output, call.is_error) == ("ls", '{"a":1}', "out", False)
    assert transcripts.session_starts(read).first().cwd == "/x"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"url": f"http://{h}/", "ts": f"2024-01-01T00:00:{s:02d}Z"}) for h, s in (("a", 0), ("a", 1), ("b", 2), ("a", 9), ("a", 30))))
    stream = tail.tail(spark, str(tmp_path / "in"), "url string, ts timestamp")
    seen, failed = [], []

    def send(rows, n):
        if not failed:
            failed.append(n)
            raise OSError("once")
        seen.extend(r.url for r in rows.collect())

    tail.deliver(tail.url_filter(stream, "url", ["//a"]), send, str(tmp_path / "c1")).awaitTermination()
    assert seen == ["http://a/"] * 4
    (tmp_path / "in/b.json").write_text(json.dumps({"url": "http://z/", "ts": "2024-01-01T01:00:00Z"}))
    quiet = []
    for _ in range(2):
        tail.deliver(tail.debounced(stream, "url", "ts"), lambda rows, n: quiet.extend((r.url, r.n) for r in rows.collect()), str(tmp_path / "c2")).awaitTermination()
        quiet_now = sorted(set(quiet))
    assert {("http://a/", 2), ("http://a/", 1), ("http://b/", 1)} <= set(quiet_now)


def test_queue_transitions(spark):
    schema = "path string, sha256 string, status string, attempts int, last_error string, next_attempt_at timestamp, enqueued_at timestamp, updated_at timestamp"
    queue = spark.sql("select 'p' path, 's1' sha256, 'pending' status, 0 attempts, cast(null as string) last_error, cast(null as timestamp) next_attempt_at, timestamp'2024-01-01' enqueued_at, timestamp'2024-01-01' updated_at union all select 'q', 's2', 'in_flight', 9, null, null, timestamp'2024-01-02', timestamp'2024-01-02'")
    assert queue.columns == [c.split()[0] for c in schema.split(", ")]
    now = F.lit("2024-01-03").cast("timestamp")
    claimed = sync.claim(queue, now, 5)
    assert [r.path for r in sync.after_claim(queue, claimed, now).where("status = 'in_flight'").orderBy("path").collect()] == ["p", "q"]
    failed = sync.after_failure(queue, spark.createDataFrame([("p", "s1", "e"), ("q", "s2", "e")], "path string, sha256 string, error string"), now)
    assert [(r.status, r.attempts, str(r.next_attempt_at)) for r in failed.orderBy("path").collect()] == [("pending", 1, "2024-01-03 00:00:01"), ("failed", 10, "2024-01-03 00:08:32")]


def test_search_prefix_and_hybrid(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apples and pears"), (3, "blue")], "id int, text string")
    assert {r.id for r in search.bm25(docs, "id", "text", "apple").collect()} == {1}
    assert {r.id for r in search.bm25(docs, "id", "text", "red appl", last_as_prefix=True).collect()} == {1, 2}
    left = spark.createDataFrame([(1, 2.0), (2, 1.0)], "id int, score double")
    assert [r.id for r in search.hybrid(left, left.where("id = 2"), 5).collect()] == [2, 1]


def test_hybrid_ranks_all_rows(spark):
    words = spark.createDataFrame([(i, float(-(i // 2))) for i in range(1000)], "id int, score double")
    vectors = spark.createDataFrame([(i, float(i * 7919 % 1000)) for i in range(1000)], "id int, score double")
    rank = lambda rows: {i: r for r, (_, i) in enumerate(sorted((-s, i) for i, s in rows), 1)}
    a, b = rank([tuple(r) for r in words.collect()]), rank([tuple(r) for r in vectors.collect()])
    assert {r.id: r.r for r in search.ranked(words.repartition(7)).collect()} == a
    expected = sorted(((1 / (60 + a[i]) + 1 / (60 + b[i]), i) for i in range(1000)), key=lambda x: (-x[0], x[1]))[:50]
    got = [(r.score, r.id) for r in search.hybrid(words, vectors, 50).collect()]
    assert [i for _, i in got] == [i for _, i in expected] and all(abs(x - y) < 1e-12 for (x, _), (y, _) in zip(got, expected))
    assert max(max(a[i], b[i]) for _, i in expected) > 200
    assert search.hybrid(words.limit(0), vectors.limit(0), 5).count() == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_row_style_transcripts(spark):
    row = lambda kind, **payload: json.dumps({"type": kind, "timestamp": "2026-01-01T00:00:00Z", "payload": payload})
    lines = [
        row("session_meta", cwd="/x", model_provider="acme", base_instructions={"text": "be kind"}),
        row("turn_context", turn_id="t1", model="m1", approval_policy="ask", sandbox_policy={"type": "read-only"}),
        row("event_msg", type="user_message", message="look", images=["data:image/gif;base64,AA"], local_image_paths=["/tmp/a.JPG"]),
        row("response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "one"}, {"type": "input_image"}, {"type": "output_text", "text": "two"}]),
        row("response_item", type="function_call", call_id="c1", name="ls", arguments='{"a": 1}'),
        row("response_item", type="function_call_output", call_id="c1", output="files"),
        row("response_item", type="custom_tool_call", id="c2", name="patch", input="not json"),
        row("event_msg", type="exec_command_end", call_id="c1", output="files", exit_code=2),
        row("turn_context", turn_id="t2", model="m2", approval_policy="never", sandbox_policy={"type": "full"}),
        row("event_msg", type="token_count", info={"last_token_usage": {}, "total_token_usage": {"input_tokens": 5, "total_tokens": 9}}),
        row("event_msg", type="agent_message", message="done"),
        row("event_msg", type="mcp_tool_call_end", call_id="c3", result={"Err": "no"}),
        row("response_item", type="strange"),
        "[1]", "no json",
        row("compacted", replacement_history=[]),
        row("response_item", type="reasoning", summary=[{"type": "summary_text", "text": "why"}], encrypted_content="zz"),
    ]
    frame = turn_logs.row_events(spark.createDataFrame([("f", i, x) for i, x in enumerate(lines, 1)], "file string, line_no int, line string"))
    got = {r.id: r for r in frame.collect()}
    assert {i: r.type for i, r in got.items()} == {
        "L1": "session_start", "L2": "turn_start", "L3": "user_message", "L3#img0": "attachment", "L3#imgref0": "attachment", "L4": "assistant_message", "L5": "tool_call", "L6": "tool_result", "L7": "tool_call",
        "L8": "tool_result", "L9": "turn_start", "L9#approval": "operator", "L9#sandbox": "operator", "L10": "token_usage", "L11": "assistant_message", "L12": "tool_result", "L13": "opaque", "L16": "lifecycle", "L17": "assistant_reasoning",
    }
    assert [got[i].text for i in ("L1", "L3", "L4", "L6", "L9#approval", "L9#sandbox", "L11", "L17")] == ["be kind", "look", "one\n[image]\ntwo", "files", "never", "full", "done", "why"]
    assert (got["L4"].model, got["L11"].model, got["L10"].provider, got["L10"].input_tokens, got["L10"].total_tokens) == ("m1", "m2", "acme", 5, 9)
    assert (got["L5"].input, got["L7"].input, got["L7"].tool_call_id, got["L8"].exit_code, got["L12"].is_error, got["L16"].name) == ('{"a":1}', "{}", "c2", 2, True, "context_compacted")
    assert (got["L3#img0"].media_type, got["L3#imgref0"].media_type, got["L3#imgref0"].name) == ("image/gif", "image/jpeg", "a.JPG")
    assert got["L9#approval"].raw is None and got["L9#approval"].synthesized and got["L9"].raw == lines[8]


def brute_compacted(events, budget, reserve, passes):
    """events: (seq, type, text, cost, emitted) in order."""
    events = [e for e in events if e[1] not in sessions.NOISE]
    n_head = next((i for i, e in enumerate(events) if e[1] != "session_start"), len(events))
    head, body = events[:n_head], events[n_head:]
    used = sum(e[3] for e in head)
    if used >= budget:
        return [e[0] for e in head]
    kept = body
    if used + sum(e[3] for e in body) > budget:
        kept, used = [], used + reserve
        for e in reversed(body):
            if used + e[3] > budget:
                break
            kept.insert(0, e)
            used += e[3]
    for _ in range(passes):
        if sum(e[4] for e in head + kept) <= budget or not kept:
            break
        kept = kept[max(1, len(kept) // 5) :]
    return [e[0] for e in head + kept]


@pytest.mark.parametrize("emitted", [False, True])
def test_compaction_equals_brute_force(spark, emitted):
    import random

    rng, rows, expected = random.Random(6), [], set()
    for s in range(40):
        talk = []
        for i in range(rng.randint(0, 40)):
            kind = "session_start" if i < s % 3 else rng.choice(["user_message", "assistant_message", "tool_call", "tool_result", "lifecycle", "opaque"])
            cost = rng.choice([1, 30, 90, 300]) * (1 if i else rng.choice([1, 1, 30]))
            talk.append((i, kind, "x" * rng.randint(0, 30), cost, cost + rng.choice([0, 20, 200])))
        rows += [(s, *e) for e in talk]
        expected |= {(s, i) for i in brute_compacted(talk, 2600, 1000, sessions.PASSES if emitted else 0)}
    frame = spark.createDataFrame(rows, "session int, seq int, type string, text string, cost long, emitted long")
    kept, dropped = sessions.compacted(frame, "session", "seq", F.col("cost"), 2600, F.col("emitted") if emitted else None, max_output=10, summary=False)
    got = kept.collect()
    assert {(r.session, r.seq) for r in got} == expected and len(got) == len(expected)
    assert all(len(r.text) <= 13 for r in got if r.type == "tool_result") and kept.columns == frame.columns
    quiet = [r for r in rows if r[2] not in sessions.NOISE]
    assert {r.session: r.n_dropped for r in dropped.collect()} == {s: n for s in range(40) if (n := sum(r[0] == s for r in quiet) - sum(x[0] == s for x in expected))}
    assert sessions.compacted(frame.where("false"), "session", "seq", F.col("cost"), 100)[0].count() == 0
