"""Sources by name, large files, checkouts, verifiers and streams that reconcile."""

import json

import pytest
from pyspark.sql import functions as F

from snaplake.catalog import Resources, Snapshot
from snaplake.functions import text as T
from snaplake.operators import checkouts, files, query, sessions, sync, verify
from snaplake.sources import plugins, transcripts, uploads
from snaplake.streaming import tail


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    texts = {"a.jsonl": "".join(f"line {i}\n" if i % 7 else "\n" for i in range(5_000)) + "cut off", "b.jsonl": "one\r\ntwo\n", "c.jsonl": "no end", "d.jsonl": "", "e.jsonl": "\n\né\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    expected = sorted((name, i + 1, x) for name, text in texts.items() for i, x in enumerate(text.split("\n")[:-1]) if x)
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = transcripts.read_lines(spark, str(tmp_path)).collect()
        assert sorted((r.file.split("/")[-1], r.line_no, r.line) for r in got) == expected
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sources_by_name(spark, tmp_path):
    row = json.dumps({"type": "user", "uuid": "u", "sessionId": "s", "message": {"role": "user", "content": "hi"}})
    for folder in ("desktop", "desktop-sessions", "desktop/session-env"):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "x.jsonl").write_text(row + "\n")
    source = plugins.named("desktop")
    assert source.files(spark, str(tmp_path)).count() == 2 and [r.text for r in source.read(spark, str(tmp_path)).collect()] == ["hi", "hi"]
    (tmp_path / "desktop" / "y.txt").write_text("t")
    assert plugins.named("raw").files(spark, str(tmp_path)).count() == 3
    with pytest.raises(ValueError):
        plugins.named("raw").read(spark, str(tmp_path))
    with pytest.raises(KeyError):
        plugins.named("none such")
    plugins.register(plugins.Source("own", events=lambda lines: lines.select(F.upper("line").alias("text"))))
    assert plugins.named("own").read(spark, str(tmp_path / "desktop")).first().text.startswith('{"TYPE"')


def test_payloads_are_unpacked_and_kept_ones_reused(spark):
    files = spark.createDataFrame([("a", b"x" * 500), ("b", b"y"), ("c", None)], "path string, content binary")
    packed = uploads.payloads(files)
    assert {r.path: bytes(r.content) for r in uploads.unpacked(packed).collect()} == {"a": b"x" * 500, "b": b"y", "c": b""}
    assert {r.path: bytes(r.content) for r in uploads.unpacked(packed.drop("codec")).collect()}["a"] == b"x" * 500
    signed = packed.drop("content").withColumn("sha256", F.lit("s"))
    missing, good = uploads.fetched(signed, signed.where("path = 'a'").withColumn("content", F.lit("k")))
    assert sorted(r.path for r in missing.collect()) == ["b", "c"] and [r.path for r in good.collect()] == ["a"]


def test_checkouts_replay_compact_and_begin(spark, tmp_path):
    index = spark.createDataFrame([("root", None, None), ("child", "root", 2)], "id string, forked_from string, fork_point long")
    events = spark.createDataFrame([("root", i, "user_message", f"r{i}") for i in range(3)] + [("child", i, "user_message", f"c{i}") for i in range(2)], "session string, seq int, type string, text string")
    starts = spark.createDataFrame([("child", "head"), ("other", "x")], "id string, text string")
    out, listed = checkouts.checked_out(sessions.ancestors(index).where("id = 'child'"), events, starts, 10_000)
    assert [(r.type, r.text) for r in out.orderBy("place").collect()] == [("session_start", "head"), ("user_message", "r0"), ("user_message", "r1"), ("user_message", "c0"), ("user_message", "c1")]
    assert listed.first().asDict() == {"id": "child", "event_count": 5, "dropped": 0}
    folder = str(tmp_path / "store")
    checkouts.write_store(index, events, folder, buckets=4)
    assert sorted(r.text for r in checkouts.read_session(spark, folder, "child", buckets=4).collect()) == ["c0", "c1"]
    lines = spark.createDataFrame([('{"_meta": {}}',), ("{}",), ("no",), (None,)], "line string")
    assert [r[0] for r in lines.select(checkouts.is_checkout(F.col("line"), "_meta")).collect()] == [True, False, False, False]


def test_repositories_are_found_by_registry_scan_or_origin(spark):
    rows = spark.createDataFrame([(1, "a", "/o"), (2, "b", "/o"), (3, "c", "/o"), (4, None, None)], "id int, repo_url string, origin_cwd string")
    registry = spark.createDataFrame([("a", "/old", 1), ("a", "/new", 2)], "repo_url string, folder string, last_seen int")
    scanned = spark.createDataFrame([("a", "/s"), ("b", "/t"), ("b", "/s")], "repo_url string, folder string")
    got = {r.id: (r.folder, r.found_by) for r in checkouts.resolved(rows, registry, scanned).collect()}
    assert got == {1: ("/new", "registry"), 2: ("/s", "scan"), 3: ("/o", "origin"), 4: (None, None)}
    assert sessions.freshest(registry, "repo_url", "last_seen").first().folder == "/new"


def test_verifiers_give_scores():
    class Own:
        score = 0.4

    def failing(x):
        assert x == 2, "x is off"

    assert [verify.verified(lambda v=v: v).score for v in (True, 0.25, 7, -1, {"score": 0.5}, Own(), float("nan"))] == [1.0, 0.25, 1.0, 0.0, 0.5, 0.4, 0.0]
    assert verify.verified(lambda: "none").error and verify.verified(failing, 1).error == "AssertionError: x is off\nassert 1 == 2" or verify.verified(failing, 1).error.startswith("AssertionError: x is off")
    assert verify.verified(failing, x=1).score == 0.0


def test_columns_that_are_missing_are_null(spark):
    assert query.projected(spark.range(1), ["x", "id"]).first().asDict() == {"x": None, "id": 0}


def test_streams_reconcile_and_log(spark, tmp_path):
    spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string").write.json(str(tmp_path / "in"))
    seen = []
    stream = tail.tail(spark, str(tmp_path / "in"), "path string, sha256 string")
    remote = lambda: spark.createDataFrame([("a", "1"), ("b", "old")], "path string, sha256 string")
    tail.reconciled(stream, remote, lambda rows, n: seen.extend((r.path, r.status) for r in rows.collect()), str(tmp_path / "state"), None).awaitTermination()
    assert seen == [("b", "changed")]
    spark.createDataFrame([({"Authorization": "Bearer abcdefghijk"}, "x" * 30)], "request_headers map<string,string>, request_body string").write.json(str(tmp_path / "traffic"))
    traffic = tail.tail(spark, str(tmp_path / "traffic"), "request_headers map<string,string>, request_body string")
    tail.write_traffic(traffic, str(tmp_path / "log"), str(tmp_path / "state2"), most=10).awaitTermination()
    row = spark.read.json(str(tmp_path / "log")).first()
    assert row.request_headers.Authorization == "Bearer a...[REDACTED]" and row.request_body == "x" * 10 and row.request_body_length == 30
    counted = tail.progress(tail.tail(spark, str(tmp_path / "in"), "path string, sha256 string"), "path", ["a"])
    q = counted.writeStream.format("memory").queryName("so_far").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.status: (r.n, r.done) for r in spark.table("so_far").collect()} == {"a": (1, True), "b": (1, False)}


def test_rows_by_key_and_writes(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "x int, y int, v string")
    snap = Snapshot(spark, {"t": rows, "u": rows}, {"t": ["x", "y"], "u": ["x"]})
    assert [r.v for r in snap.by_key("t", (1, 2)).collect()] == ["b"] and snap.by_key("u", 1, 2).count() == 3 and snap.by_key("t").count() == 0
    new, n = snap.write("t", update={"v": "upper(v)"}, where="x = 1")
    assert n == 2 and sorted(r.v for r in new.frame("t").collect()) == ["A", "B", "c"] and sorted(r.v for r in snap.frame("t").collect()) == ["a", "b", "c"]
    new, n = new.write("t", delete=True, where="y = 1")
    assert n == 2 and [r.v for r in new.frame("t").collect()] == ["B"]
    new, n = new.write("t", insert=rows.limit(1))
    assert n == 1 and new.frame("t").count() == 2
    orders = spark.createDataFrame([(1,)], "k int")
    assert snap.table("t").having(orders, {"x": "k"}).count() == 2 and snap.table("t").having(orders, {"x": "k"}, without=True).count() == 1


def test_resources_are_made_once():
    made = []
    known = Resources()
    known.add("db://current", lambda: made.append(1) or "snapshot")
    assert known.get("db://current") == known.get("db://current") == "snapshot" and made == [1]
    with pytest.raises(KeyError):
        known.get("db://seed")
    with pytest.raises(ValueError):
        known.add("current", list)


def test_files_are_looked_up_by_ending(spark):
    rows = spark.createDataFrame([("/a/dataroom/x.txt",), ("/a/long/folder/x.txt",), ("/b/yx.txt",), ("x.txt2",)], "path string")
    assert files.lookup(rows, "x.txt", "dataroom").first().path == "/a/long/folder/x.txt"
    assert files.lookup(rows, "x.txt").first().path == "/a/dataroom/x.txt"
    assert files.lookup(rows, "/b/yx.txt").first().path == "/b/yx.txt" and files.lookup(rows, "none").count() == 0


def test_manifests_are_published_and_rows_upserted(spark, tmp_path):
    listed = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    sync.publish(listed, str(tmp_path))
    got, root = sync.published(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("a", "1"), ("b", "2")] and root == sync.manifest_root(listed.repartition(3)).first().root
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, t string, n int")
    assert sorted(map(tuple, sync.upserted(rows, spark.createDataFrame([(2, "B"), (3, "c"), (1, None)], "id int, t string")).collect()), key=str) == [(1, "a", 1), (2, "B", 2), (3, "c", None)]


def test_pages_over_stores(spark):
    kind = "id string, last_active string, v int"
    first = spark.createDataFrame([(f"s{i:03d}", f"2024-01-{i % 28 + 1:02d}", 1) for i in range(0, 120, 2)], kind)
    second = spark.createDataFrame([(f"s{i:03d}", f"2024-02-{i % 28 + 1:02d}", 2) for i in range(120)], kind)
    rows = {r.id: r for r in second.collect()} | {r.id: r for r in first.collect()}
    order = sorted(rows.values(), key=lambda r: (r.last_active, r.id), reverse=True)
    seen, cursor = [], None
    while True:
        got = sessions.merged_page([first, second], 7, cursor).collect()
        seen += got[:7]
        if len(got) <= 7:
            break
        cursor = sessions.cursor_of(got[6].last_active, got[6].id)
    assert seen == order


def test_small_text_functions(spark):
    rows = spark.createDataFrame([("a.PNG", "data:text/plain;base64,xx"), ("b.jpg", None), ("c", "x")], "n string, d string")
    assert [r[0] for r in rows.select(T.media_type(F.col("n"), F.col("d"))).collect()] == ["text/plain", "image/jpeg", "application/octet-stream"]
    row = rows.select(T.row_label(F.struct("n", "d"), 20).alias("l"), T.path_id(F.col("n"), "p-").alias("p"), T.folder_code(F.lit("/a b/é_1")).alias("f"), T.json_has(F.lit('{"k": null}'), "k").alias("j"), T.json_has(F.lit("no"), "k").alias("o")).first()
    assert len(row.l) == 20 and row.l.endswith("…") and len(row.p) == 26 and row.f == "-a-b--_1" and row.j and not row.o
    assert T.quoted('a"b') == '"a""b"'
