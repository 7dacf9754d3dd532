"""Versioned tables: writers at once, writes that die, pinned readers, stores over one another."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from snaplake.sources.versions import ChainedStores, Conflict, Version, VersionedSessions, VersionedTable


def ids(frame):
    return sorted(r.id for r in frame.collect())


def rows(spark, *values, kind="id long, v string"):
    return spark.createDataFrame([(i, "x") for i in values], kind)


def test_versions_stay_as_they_were(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() is None and t.versions() == []
    with pytest.raises(KeyError):
        t.read()
    assert t.append(rows(spark, 1, 2)) == 1
    pinned = t.read()
    assert t.append(rows(spark, 3)) == 2 and t.delete("id = 1 or v is null") == 3 and t.upsert(rows(spark, 2, 9), ["id"]) == 4 and t.compact() == 5
    assert ids(pinned) == [1, 2] and [ids(t.read(n)) for n in t.versions()] == [[1, 2], [1, 2, 3], [2, 3], [2, 3, 9], [2, 3, 9]]
    assert len(t.version().parts) == 1 and t.read(1).schema == t.read().schema
    assert t.delete("true") == 6 and t.read().count() == 0 and t.append(rows(spark, 5)) == 7 and ids(t.read()) == [5]
    with pytest.raises(KeyError):
        t.read(99)


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(rows(spark, 0))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: VersionedTable(spark, str(tmp_path / "t")).append(rows(spark, i)), range(1, 13)))
    assert ids(t.read()) == list(range(13)) and t.versions() == list(range(1, 14))


def test_a_writer_that_was_overtaken_starts_over(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.append(rows(spark, 1, 2))
    seen = []

    def change(old):
        if not seen:
            two.append(rows(spark, 3))  # another writer is first
        seen.append(1)
        return old.where("id <> 1")

    assert one.rewrite(change) == 3 and len(seen) == 2 and ids(one.read()) == [2, 3]
    with pytest.raises(Conflict):
        one.commit(Version(3, "id long", ()))
    assert ids(one.read()) == [2, 3]


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(rows(spark, 1))
    with pytest.raises(Exception):
        t.append(rows(spark, 2).withColumn("v", F.raise_error(F.lit("no")).cast("string")))

    def dies(version):
        raise RuntimeError("killed")

    monkeypatch.setattr(t, "commit", dies)
    with pytest.raises(RuntimeError):
        t.append(rows(spark, 3))
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert again.versions() == [1] and ids(again.read()) == [1] and again.append(rows(spark, 4)) == 2 and ids(again.read()) == [1, 4]


def test_compaction_keeps_what_came_meanwhile(spark, tmp_path):
    one, two = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    for i in range(4):
        one.append(rows(spark, i))
    written = one._written

    def slow(frame):
        name = written(frame)
        two.append(rows(spark, 9))
        return name

    one._written = slow
    assert one.compact() == 6 and ids(one.read()) == [0, 1, 2, 3, 9] and len(one.version().parts) == 2


def test_session_stores_over_one_another(spark, tmp_path):
    session = lambda *x: spark.createDataFrame(x, "id string, last_active string, title string")
    event = lambda *x: spark.createDataFrame(x, "session_id string, seq int, text string")
    near, far = (VersionedSessions(spark, str(tmp_path / n)) for n in ("near", "far"))
    near.create(session(("abc", "2024-01-03", "near")), event(("abc", 0, "n0")))
    far.create(session(("abc", "2024-01-01", "far"), ("abd", "2024-01-02", "far"), ("x", "2024-01-04", "far")), event(("abc", 0, "f0"), ("abd", 0, "d0"), ("x", 0, "x0")))
    both = ChainedStores(near, far)
    assert sorted((r.id, r.title) for r in both.sessions().collect()) == [("abc", "near"), ("abd", "far"), ("x", "far")]
    assert [r.id for r in both.page(2).collect()][:2] == ["x", "abc"]
    assert [r.text for r in both.events("abc").collect()] == ["n0"] and [r.text for r in both.events("abd").collect()] == ["d0"]
    assert both.get("abd") == "abd" and both.get("x") == "x"
    with pytest.raises(ValueError):
        both.get("ab")
    with pytest.raises(KeyError):
        both.get("zz")
    near.append(event(("abc", 1, "n1")))
    assert near.sessions().first().last_active == "2024-01-03" and both.events("abc").count() == 2
    near.append(event(("abc", 2, "n2")), session(("abc", "2024-02-01", "later")))
    assert [(r.last_active, r.title) for r in near.sessions().collect()] == [("2024-02-01", "later")]
    near.delete("abc")
    assert [r.text for r in both.events("abc").collect()] == ["f0"] and near.sessions().count() == 0
