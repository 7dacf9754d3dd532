"""Lines by byte ranges: batches whatever their size, nested folders, and files that grow under a stream."""

import os
import random

import pytest
from pyspark.sql import functions as F

from snaplake.sources import plugins, ranges
from snaplake.streaming import tail


def files_of(folder):
    """Files of some depth: blank, long and open lines, CR, invalid UTF-8, none at all."""
    rng = random.Random(1)
    contents = {"a.jsonl": b"one\n\nthree\n", "x/y/b.jsonl": b"".join(b"%d %s\n" % (i, b"z" * rng.randrange(0, 900)) for i in range(300)), "x/open.jsonl": b"whole\nopen", "x/none.jsonl": b"", "x/only.jsonl": b"never ended", "x/y/z/long.jsonl": b"s\n" + b"L" * 5000 + b"\nend\r\n", "bad.jsonl": b"\xff\xfe ok\nnext\n", "x/other.txt": b"no\n"}
    hidden = {"shell_snapshots/c.jsonl": b"hidden\n", "x/auth.json/d.jsonl": b"hidden\n"}
    for name, content in {**contents, **hidden}.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)
    return {n: c for n, c in contents.items() if n.endswith(".jsonl")}


def lines_in(content):
    whole = content[: content.rfind(b"\n") + 1].split(b"\n")[:-1]
    return [(k, x.decode("utf-8", "replace")) for k, x in enumerate(whole, 1) if x]


@pytest.mark.parametrize("size", [4000, 128_000_000])
def test_line_numbers_do_not_depend_on_ranges(spark, tmp_path, size):
    contents = files_of(tmp_path)
    got = ranges.read_lines(spark, [str(tmp_path)], "*.jsonl", plugins.named("blocks").excluded, size).collect()
    expected = [(f"file://{tmp_path}/{n}", k, x) for n, c in contents.items() for k, x in lines_in(c)]
    assert sorted(map(tuple, got)) == sorted(expected)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_every_line_is_in_one_range(tmp_path, size):
    for name, content in files_of(tmp_path).items():
        if len(content) > 10_000 and size < 7:
            content = content[:3000]
            (tmp_path / name).write_bytes(content)
        parts = ranges.cut(str(tmp_path / name), 0, len(content), size)
        got = [(at, x) for p in parts for b in ranges.batches(p) for at, x in zip(b.column("at").to_pylist(), b.column("line").to_pylist())]
        expected, at = [], 0
        for line in content[: content.rfind(b"\n") + 1].split(b"\n")[:-1]:
            expected.append((at, line.decode("utf-8", "replace")))
            at += len(line) + 1
        assert got == expected


def test_excluded_files_are_never_opened(spark, tmp_path):
    files_of(tmp_path)
    locked = tmp_path / "x" / "session-env" / "e.jsonl"
    locked.parent.mkdir()
    os.symlink("/nowhere/at/all", locked)
    got = ranges.read_ranges(spark, [f"file://{tmp_path}"], excluded=["session-env", "shell_snapshots", "auth.json"])
    assert got.where(F.contains("line", F.lit("hidden"))).count() == 0
    assert ranges.read_ranges(spark, [str(tmp_path / "none such")]).count() == 0
    names = [n for n, _ in ranges.walked(str(tmp_path), "*.{jsonl,txt}", frozenset(["x"]))]
    assert names == [f"file://{tmp_path}/{n}" for n in ("a.jsonl", "bad.jsonl", "shell_snapshots/c.jsonl")]


def test_sources_read_what_they_list(spark, tmp_path):
    for name in ("p/q/s1.jsonl", "s2.jsonl", "p/shell_snapshots/s3.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('{"type": "user", "uuid": "u", "sessionId": "%s", "message": {"role": "user", "content": "hi"}}\n' % name)
    source = plugins.named("blocks")
    listed = {r.path.rsplit("/", 1)[-1] for r in source.files(spark, str(tmp_path)).collect()}
    assert listed == {"s1.jsonl", "s2.jsonl"} and {r.session_id for r in source.read(spark, str(tmp_path)).collect()} == {"p/q/s1.jsonl", "s2.jsonl"}
    for sub in ("desktop/a", "desktop-sessions/b/c"):
        (tmp_path / sub).mkdir(parents=True)
        (tmp_path / sub / "t.jsonl").write_text('{"type": "user", "uuid": "u", "sessionId": "%s", "message": {"role": "user", "content": "hi"}}\n' % sub)
    assert {r.session_id for r in plugins.named("desktop").read(spark, str(tmp_path)).collect()} == {"desktop/a", "desktop-sessions/b/c"}


def test_appended_bytes_are_read_once(spark, tmp_path):
    """Two files grow between runs, one by half a line at first; each run goes on from the checkpoint."""
    root, seen = tmp_path / "in", []
    root.mkdir()
    steps = [{"a.jsonl": b"1\n2\n", "b.jsonl": b"x"}, {"b.jsonl": b"y\nz\n"}, {}, {"a.jsonl": b"3\n" * 50, "sub/c.jsonl": b"new\n", "b.jsonl": b"open"}]
    for step in steps:
        for name, more in step.items():
            (root / name).parent.mkdir(exist_ok=True)
            with open(root / name, "ab") as f:
                f.write(more)
        run = []
        stream = ranges.tail_lines(spark, [str(root)], range_bytes=16)
        tail.deliver(stream, lambda rows, n: run.extend((r.file.rsplit("/", 1)[-1], r.at, r.line) for r in rows.collect()), str(tmp_path / "state")).awaitTermination()
        seen.append(sorted(run))
    assert seen[0] == [("a.jsonl", 0, "1"), ("a.jsonl", 2, "2")]
    assert seen[1] == [("b.jsonl", 0, "xy"), ("b.jsonl", 3, "z")]
    assert seen[2] == []
    assert seen[3] == sorted([("a.jsonl", 4 + 2 * i, "3") for i in range(50)] + [("c.jsonl", 0, "new")])


def test_files_written_anew_are_read_from_their_start(tmp_path):
    file = tmp_path / "a.jsonl"
    reader = ranges._Tail(ranges._Options({"path": str(tmp_path)}))
    file.write_bytes(b"1\n2\n3\n")
    first = reader.latestOffset()
    file.write_bytes(b"4\n")
    second = reader.latestOffset()
    parts = reader.partitions(first, second)
    assert [x for p in parts for b in ranges.rows_of(p) for x in b.column("line").to_pylist()] == ["4"]
    assert reader.partitions(second, reader.latestOffset())[0].ranges == []


def test_small_files_share_a_task():
    small = [ranges.ByteRange(f"f{i}", 0, 10, 10) for i in range(1000)]
    large = ranges.cut("g", 0, 350, 100)
    packs = ranges.packed(small + large, 100)
    assert [r for p in packs for r in p.ranges] == small + large and len(packs) < 160
    assert all(sum(r.end - r.start for r in p.ranges) <= 100 for p in packs)


def test_writing_lines_replaces_files_whole(spark, tmp_path):
    rows = [("d/a.txt", i, f"line {i} é") for i in range(2000)] + [("b.txt", 0, None)]
    frame = spark.createDataFrame(rows, "file string, nth int, line string").repartition(5)
    assert ranges.write_lines(frame, str(tmp_path / "out")) == 2
    assert ranges.write_lines(frame.where("nth < 2"), f"file://{tmp_path}/out") == 2
    assert (tmp_path / "out" / "d" / "a.txt").read_text() == "line 0 é\nline 1 é\n" and (tmp_path / "out" / "b.txt").read_text() == "\n"
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".part")]
