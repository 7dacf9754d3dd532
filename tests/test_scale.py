"""Sessions cut by position, tables reconciled by ranges of keys, manifests as stored trees."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from snaplake.operators import diff, manifest, reconcile, segments, sync
from snaplake.operators import sessions as S


def records_read(spark, work):
    """What work gives, and the records that its scans read."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    out = work()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {i for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for i in info.stageIds}
    sc.setJobGroup("", "")
    return out, sum(store.lastStageAttempt(i).inputRecords() for i in stages if tracker.getStageInfo(i))


def skewed(spark, n=3000):
    """One session has nine tenths of the rows; some rows have none."""
    rng = random.Random(1)
    rows = [("big" if rng.random() < 0.9 else rng.choice(["a", "b", None, f"s{i % 40}"]), i, rng.choice([None, None, 1, 2, 3]), rng.choice("xyz"), "clash") for i in range(n)]
    return spark.createDataFrame(rows, "session string, seq int, v int, kind string, _carry string").withColumnRenamed("_carry", "note").repartition(5)


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_cut_sessions_equal_windows(spark, parts):
    events = skewed(spark)
    args = (events, "session", "seq")
    for one, two in (
        (S.suffix_within(*args, F.coalesce("v", F.lit(0)), 400), S.suffix_within(*args, F.coalesce("v", F.lit(0)), 400, parts=parts)),
        (S.suffix_within(*args, F.col("v"), 400), S.suffix_within(*args, F.col("v"), 400, parts=parts)),
        (S.carried_forward(*args, F.col("v"), "held"), S.carried_forward(*args, F.col("v"), "held", parts=parts)),
        (S.changes_of(*args, "kind"), S.changes_of(*args, "kind", parts=parts)),
        (S.changes_of(*args, "v"), S.changes_of(*args, "v", parts=parts)),
    ):
        key = lambda r: str(tuple(r))
        assert one.columns == two.columns and sorted(map(key, one.collect())) == sorted(map(key, two.collect()))
    assert S.carried_forward(events.limit(0), "session", "seq", F.col("v"), "held", parts=parts).count() == 0


def test_no_task_holds_a_huge_session(spark):
    def largest(**options):
        out = S.carried_forward(skewed(spark, 20_000), "session", "seq", F.col("v"), "held", **options)
        return max(r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(F.hash("held", "held_changed"))).collect())

    assert largest(parts=8) <= 2 * 20_000 / 8 < largest()
    rows = segments.parted(skewed(spark, 20_000), "session", "seq", 8)
    assert segments.carries(rows, F.sum("v")).count() <= 16


def orders(spark, n, changed=(), gone=(), extra=()):
    rows = [(i, f"k{i % 3}", float(i) if i not in changed else -1.0, f'{{"a": {i}}}' if i % 2 else f'{{ "a":{i} }}', "x") for i in range(n) if i not in gone]
    rows += [(i, "new", None, None, None) for i in extra]
    return spark.createDataFrame(rows, "id long, part string, price double, props string, note string")


CASES = {"few": dict(changed={5, 700}, gone={9}, extra=[-1]), "none": {}, "all": dict(changed=set(range(2000))), "empty": dict(gone=set(range(2000)))}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("sizes", [dict(), dict(ranges=4, finer=4, few=20)])
def test_reconciled_changes_equal_the_full_diff(spark, name, sizes):
    before, after = orders(spark, 2000), orders(spark, 2000, **CASES[name])
    one = diff.table_changes(before, after, ["id"], "t")
    two = reconcile.reconciled_changes(before, after, ["id"], "t", **sizes)
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_reconciled_changes_of_odd_rows(spark):
    """Null and composite keys, a column that one side lacks, JSON in another form (no change)."""
    kind = "a int, b string, p string"
    before = spark.createDataFrame([(1, "x", '{"k": 1}'), (None, "x", "q"), (2, None, "r"), (3, "y", "s")], kind)
    after = spark.createDataFrame([(1, "x", '{"k":1}'), (None, "x", "q"), (2, None, "r"), (3, "y", "t")], kind).withColumn("more", F.lit(1))
    one, two = (f(before, after, ["a", "b"], "t") for f in (diff.table_changes, reconcile.reconciled_changes))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() > 3


def test_only_differing_ranges_are_compared(spark):
    before = spark.range(100_000).select(F.col("id"), (F.col("id") * 3).alias("v"))
    after = before.withColumn("v", F.when(F.col("id").isin(17, 90_000), 0).otherwise(F.col("v")))
    left, right = (reconcile._side(x, ["id"], ["id", "v"], dict(before.dtypes)) for x in (before, after))
    found = reconcile.differing(left, right, 4096, None, 0)
    assert found.count() == 2 and found.agg(F.sum("rows")).first()[0] < 300
    closer = reconcile.differing(left, right, 4096 * 64, found.select(F.col("range").alias("_outer")), 4096)
    assert closer.agg(F.sum("rows")).first()[0] <= 8


def some_files(spark, n, changed=()):
    return spark.range(n).select(F.concat(F.lit("home/"), F.col("id")).alias("path"), F.sha2(F.when(F.col("id").isin(*changed) if changed else F.lit(False), F.lit("other")).otherwise(F.col("id").cast("string")), 256).alias("sha256"))


def test_trees_are_read_where_they_differ(spark, tmp_path):
    n, changed = 300_000, (3, 70_001, 299_999)
    here, there = str(tmp_path / "here"), str(tmp_path / "there")
    assert manifest.build(some_files(spark, n), there) == 3
    assert manifest.build(some_files(spark, n, changed), here) == 3
    found, read = records_read(spark, lambda: sorted(map(tuple, manifest.tree_diff(spark, here, there).select("path", "status").collect())))
    assert found == sorted((f"home/{i}", "changed") for i in changed)
    assert read < 60_000
    changes = spark.createDataFrame(some_files(spark, n, changed).where(F.substring_index("path", "/", -1).isin(*map(str, changed))).collect())
    _, read = records_read(spark, lambda: manifest.apply(spark, there, changes))
    assert read < 60_000
    assert manifest.root(spark, here).first() == manifest.root(spark, there).first() and manifest.tree_diff(spark, here, there).count() == 0


def test_trees_of_any_depth_compare_and_updates_equal_a_new_tree(spark, tmp_path):
    rng = random.Random(2)
    one = [(f"p{i}", f"d{rng.randrange(5)}") for i in range(500)]
    two = [(p, "z" if rng.random() < 0.05 else s) for p, s in one if rng.random() < 0.95] + [(f"q{i}", "d") for i in range(20)]
    frames = [spark.createDataFrame(x, "path string, sha256 string") for x in (one, two)]
    here, there, other = (str(tmp_path / x) for x in ("here", "there", "other"))
    assert manifest.build(frames[0], here, leaf=4) == 2 and manifest.build(frames[1], there, leaf=400) == 1
    expected = sorted(map(tuple, sync.manifest_diff(*frames, removed=True).collect()))
    assert sorted(map(tuple, manifest.tree_diff(spark, here, there).collect())) == expected
    old, new = dict(one), dict(two)
    steps = [(p, new.get(p)) for p in old.keys() | new.keys() if old.get(p) != new.get(p)]
    for part in (steps[::2], steps[1::2], [("p0", new.get("p0"))]):
        manifest.apply(spark, here, spark.createDataFrame(part, "path string, sha256 string"))
    assert sorted(map(tuple, manifest.files_of(spark, here).collect())) == sorted(two)
    assert manifest.root(spark, here).first() == manifest.root(spark, there).first()
    manifest.build(frames[0].limit(0), other)
    assert manifest.root(spark, other).first().n == 0 and manifest.tree_diff(spark, other, there).count() == len(two)


def shuffled_bytes(spark, work):
    """What work gives, and the bytes that its stages shuffled."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    out = work()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {i for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for i in info.stageIds}
    sc.setJobGroup("", "")
    return out, sum(store.lastStageAttempt(i).shuffleWriteBytes() for i in stages if tracker.getStageInfo(i))


def test_rows_of_equal_buckets_are_not_shuffled(spark, monkeypatch):
    """Tables without keys that differ in few rows, repeats and nulls among them: the same changes with few and many buckets, and little is shuffled."""
    rows = spark.range(20_000).select((F.col("id") % 9_000).alias("a"), F.when(F.col("id") % 7 > 0, F.repeat(F.md5(F.col("id").cast("string")), 8)).alias("b"))
    after = rows.where("a <> 17").unionAll(rows.where("a in (5, 7)")).unionAll(spark.sql("select 3L a, 'new' b union all select 3L, 'new' union all select null, null"))
    got = {}
    for buckets in (1, 1_000, diff.BUCKETS):
        monkeypatch.setattr(diff, "BUCKETS", buckets)
        found, moved = shuffled_bytes(spark, lambda: diff.multiset_changes(rows, after, "t").collect())
        got[buckets] = sorted((r.change_type, r.row_id, r.before or "", r.after or "") for r in found), moved
    listed = lambda frame: [r[0] for r in frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    old, new = Counter(listed(rows)), Counter(listed(after))
    wanted = sorted([("delete", x, "") for x in (old - new).elements()] + [("insert", "", x) for x in (new - old).elements()])
    assert all(sorted((c, b, a) for c, _, b, a in changes) == wanted for changes, _ in got.values()) and len(wanted) > 8
    assert got[1_000][1] < got[1][1] / 4
    assert diff.multiset_changes(rows, rows, "t").count() == 0
