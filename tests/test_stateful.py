"""Timers and state of streams: quiet paths, late rows, the queue's transitions, restarts."""

import time
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from snaplake.operators import sync
from snaplake.streaming import stateful, tail

T0 = datetime(2024, 3, 1)


class Feed:
    """A folder that rows are put into, and a stream over it that goes on from its checkpoint."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, folder, schema
        (folder / "in").mkdir()

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(str(self.folder / "in"))

    def run(self, change):
        """What comes out of one run over what is there."""
        out = str(self.folder / f"out-{uuid.uuid4().hex}")
        frame = change(self.stream())
        tail.deliver(frame, lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(self.folder / "state")).awaitTermination()
        return self.spark.read.schema(frame.schema).parquet(out).select(*frame.columns).collect()


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema: Feed(spark, tmp_path, schema)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_a_path_comes_out_after_its_quiet_without_any_later_row(spark, feed, tmp_path):
    f = feed("path string")
    f.put([("a",), ("a",), ("b",), (None,)])
    got = []
    stream = stateful.quiet_keys(f.stream(), "path", 2.5)
    began = time.time()
    running = stream.writeStream.foreachBatch(lambda rows, n: got.extend((r.key, r.n, time.time()) for r in rows.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    while len(got) < 2 and time.time() < began + 60:
        time.sleep(0.2)
    f.put([("a",)])
    while len(got) < 3 and time.time() < began + 90:
        time.sleep(0.2)
    running.stop()
    assert sorted(x[:2] for x in got) == [("a", 1), ("a", 2), ("b", 1)] and got[0][2] - began >= 2.5


def test_quiet_by_event_time_drops_late_rows(feed):
    f = feed("path string, at timestamp")
    change = lambda s: stateful.quiet_keys(s, "path", 2.5, "at", "10 seconds")
    f.put([("a", at(0)), ("a", at(2)), ("a", at(10)), ("b", at(1))])
    first = f.run(change)
    assert sorted((r.key, r.first, r.n) for r in first) == [("a", at(0), 2)]
    f.put([("c", at(100))])
    second = f.run(change)
    assert sorted((r.key, r.first, r.n) for r in second) == [("a", at(10), 1), ("b", at(1), 1)]
    f.put([("a", at(3)), ("d", at(95)), ("e", at(300))])  # the first is later than the watermark allows
    third = f.run(change)
    assert sorted((r.key, r.first, r.n) for r in third) == [("c", at(100), 1), ("d", at(95), 1)]


COMMANDS = "path string, sha256 string, command string, error string, nth int, at timestamp"


def steps(feed, rounds, **options):
    """All steps of the rounds' commands (path, sha256, command, error, seconds), a run for each round."""
    f, out = feed(COMMANDS), []
    for round_ in rounds:
        f.put([(p, s, c, e, k, at(t)) for k, (p, s, c, e, t) in enumerate(round_)])
        out.append(f.run(lambda s: stateful.work_queue(s, by_event_time=True, **options)))
    return out


def test_transitions_over_restarts(feed):
    """Enqueued twice, claimed, done with older versions pruned, newer ones kept; each round is a run of its own."""
    got = steps(feed, [
        [("p", "v1", "enqueue", None, 0), ("p", "v1", "enqueue", None, 1), ("p", "v2", "enqueue", None, 5), ("p", "v3", "enqueue", None, 9), ("q", "w", "enqueue", None, 9)],
        [("p", "v1", "claim", None, 20), ("p", "v1", "claim", None, 21), ("p", "v2", "claim", None, 21), ("none", "x", "done", None, 22), (None, "x", "enqueue", None, 22), ("q", None, "enqueue", None, 22)],
        [("p", "v2", "done", None, 30)],
        [("p", None, "delete", None, 40), ("q", "w", "requeue", None, 40)],
    ])
    told = lambda rows: [(r.sha256, r.event, r.status) for r in sorted(rows, key=lambda r: (r.path, r.n))]
    assert told(got[0]) == [("v1", "enqueued", "pending"), ("v2", "enqueued", "pending"), ("v3", "enqueued", "pending"), ("w", "enqueued", "pending")]
    assert told(got[1]) == [("v1", "claimed", "in_flight"), ("v2", "claimed", "in_flight")]
    assert told(got[2]) == [("v2", "done", "done")]  # v1 is in flight, v3 is newer: neither is pruned
    assert sorted(told(got[3])) == [("v1", "deleted", None), ("v2", "deleted", None), ("v3", "deleted", None), ("w", "requeued", "pending")]


def test_pruning_is_of_strictly_older_rows(feed):
    got = steps(feed, [[("p", "a", "enqueue", None, 0), ("p", "b", "enqueue", None, 1), ("p", "c", "enqueue", None, 1), ("p", "b", "claim", None, 2), ("p", "b", "done", None, 3)]])
    assert [(r.sha256, r.event) for r in sorted(got[0], key=lambda r: r.n)][3:] == [("b", "claimed"), ("b", "done"), ("a", "pruned")]


def test_waits_grow_and_end(feed):
    """Each failure doubles the wait; timers tell when it is over; the last one is for good until a reset."""
    rounds, t = [[("p", "a", "enqueue", None, 0)]], 10
    for k in range(2):
        rounds.append([("p", "a", "claim", None, t), ("p", "a", "failed", f"no {k}" + "x" * 600, t + 1)])
        rounds.append([("z", "z", "enqueue", None, t + 1000)])  # time passes
        t += 2000
    rounds.append([("p", None, "reset", None, t)])
    mine = sorted((r for rows in steps(feed, rounds, attempts=2) for r in rows if r.path == "p"), key=lambda r: r.n)
    assert [(r.event, r.status, r.attempts) for r in mine] == [("enqueued", "pending", 0), ("claimed", "in_flight", 0), ("retry", "pending", 1), ("due", "pending", 1), ("claimed", "in_flight", 1), ("failed", "failed", 2), ("reset", "pending", 0)]
    ends = [r for r in mine if r.event in ("retry", "failed")]
    assert [(r.next_attempt_at - r.at).total_seconds() for r in ends] == [1.0, 2.0] and len(ends[0].last_error) == 500
    assert mine[3].at == ends[0].next_attempt_at


def test_leases_end_and_done_rows_expire(feed):
    got = steps(feed, [[("p", "a", "enqueue", None, 0), ("p", "a", "claim", None, 1), ("q", "b", "enqueue", None, 0), ("q", "b", "claim", None, 1), ("q", "b", "done", None, 2)], [("z", "z", "enqueue", None, 5000)], [("z", "y", "enqueue", None, 200_000)]])
    assert [(r.path, r.event, r.status) for r in got[1] if r.path != "z"] == [("p", "released", "pending")]
    assert [(r.path, r.event, r.status) for r in got[2] if r.path != "z"] == [("q", "expired", None)]


def test_stream_equals_the_batch_functions(spark, feed):
    """The same commands by the stream and by the functions over tables: equal rows in the end."""
    import random

    rng = random.Random(3)
    items = [(f"p{i % 7}", f"v{i}", i) for i in range(40)]
    done, failed = sorted(rng.sample(items, 12), key=lambda x: x[2]), rng.sample(items, 15)  # done in order: a newer one prunes an older that isn't done yet
    failed = [x for x in failed if x not in done]
    rounds = [[(p, v, "enqueue", None, t) for p, v, t in items], [(p, v, "failed", "e", 100) for p, v, _ in failed], [(p, v, "done", None, 101) for p, v, _ in done]]
    told = [r for rows in steps(feed, rounds) for r in rows]
    now = stateful.queue_now(spark.createDataFrame(told, stateful.STEPS))
    schema = "path string, sha256 string, status string, attempts int, last_error string, next_attempt_at timestamp, enqueued_at timestamp, updated_at timestamp"
    queue = spark.createDataFrame([], schema)
    for p, v, t in items:
        queue = queue.unionAll(spark.createDataFrame([(p, v, "pending", 0, None, at(t), at(t), at(t))], schema))
    queue = sync.after_failure(queue, spark.createDataFrame([(p, v, "e") for p, v, _ in failed], "path string, sha256 string, error string"), F.lit(at(100)).cast("timestamp"))
    queue = sync.after_success(queue, spark.createDataFrame([(p, v) for p, v, _ in done], "path string, sha256 string"), F.lit(at(101)).cast("timestamp"))
    columns = ["path", "sha256", "status", "attempts", "last_error"]
    assert sorted(map(tuple, now.select(*columns).collect())) == sorted(map(tuple, queue.select(*columns).collect()))


class Held:
    """A handle of states and timers in memory, with counts of what is asked of it."""

    def __init__(self):
        self.timers, self.registered, self.read = set(), 0, 0

    def getMapState(self, name, *schema):
        held, data = self, {}

        class Map:
            updateValue = staticmethod(data.__setitem__)
            removeKey = staticmethod(data.pop)
            containsKey = staticmethod(data.__contains__)

            def iterator(self):
                held.read += 1
                return iter(list(data.items()))

        return Map()

    def getValueState(self, name, schema):
        data = []

        class Value:
            exists = staticmethod(lambda: bool(data))
            get = staticmethod(lambda: data[0] if data else None)
            clear = staticmethod(data.clear)

            def update(self, value):
                data[:] = [value]

        return Value()

    def registerTimer(self, ms):
        self.registered += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: ms


def test_a_long_path_is_read_once_a_batch_and_has_one_timer():
    """2,000 rows of one path: half fail and wait, of which all are due at once later; some are done and prune what is older."""
    held = Held()
    queue = stateful._Queue(True, 10, 10**16, 10**16)
    queue.init(held)
    rows = [{"sha256": f"v{i}", "command": "enqueue", "error": None, "nth": 0, "at": at(i)} for i in range(2000)]
    rows += [{"sha256": f"v{i}", "command": "failed", "error": "e", "nth": 1, "at": at(5000 + i)} for i in range(0, 2000, 2)]
    rows += [{"sha256": f"v{i}", "command": "done", "error": None, "nth": 2, "at": at(5000 + i)} for i in (101, 51, 103)]
    first = list(queue.handleInputRows(("p",), iter(rows), Clock(0)))
    assert held.registered <= 2 and held.read == 1 and len(held.timers) == 1
    gone = {f"v{i}" for i in range(103)} - {"v101", "v51"}
    assert {r.sha256 for r in first if r.event == "pruned"} == gone and sum(r.event == "pruned" for r in first) == len(gone)
    ms, fired, due = stateful._us(at(9000)) // 1000, 0, []
    while held.timers and (now := min(held.timers)) <= ms:
        clock = Clock(ms)
        clock.getExpiryTimeInMs = lambda now=now: now
        due += queue.handleExpiredTimer(("p",), clock, clock)
        held.timers.discard(now)  # as Spark does
        fired += 1
    assert fired == 1 and held.read == 2
    assert [(r.sha256, r.event, r.at) for r in sorted(due, key=lambda r: r.n)] == [(f"v{i}", "due", at(5001 + i)) for i in range(104, 2000, 2)]
    late = list(queue.handleInputRows(("p",), iter([{"sha256": None, "command": "delete", "error": None, "nth": 0, "at": at(9001)}]), Clock(ms)))
    assert {r.sha256 for r in late} == {f"v{i}" for i in range(2000)} - gone and not held.timers
