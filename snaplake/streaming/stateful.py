"""Streams with state of their own and timers: quiet periods of paths, and a work queue.

transformWithState needs RocksDB as the state store; with_state sets it where the session has another.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Seconds of quiet, of the first and the longest wait, attempts, lease of a claim, time that done rows stay.
QUIET_S, FIRST_WAIT_S, LONGEST_WAIT_S, ATTEMPTS, LEASE_S, KEPT_S = 2.5, 0.5, 1800, 10, 3600, 86_400
#: Characters of an error that are kept.
ERROR_CHARS = 500


def with_state(spark: SparkSession) -> SparkSession:
    if spark.conf.get(_PROVIDER, None) != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    return spark


def _moment(us: int) -> datetime:
    """UTC without a zone, as rows hold it, of microseconds, as states do."""
    return datetime(1970, 1, 1) + timedelta(microseconds=us)


def _us(moment: datetime) -> int:
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return (moment - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def _timer(us: int) -> int:
    """The first millisecond that isn't before."""
    return -(-us // 1000)


class _Quiet(StatefulProcessor):
    """One row for a key once nothing came for it for so long; a timer tells, no later row is needed."""

    def __init__(self, quiet: int, by_event_time: bool):
        self.quiet, self.by_event_time = quiet, by_event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, n long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        times = sorted(_us(r["at"]) if self.by_event_time else now for r in rows)
        out = []
        first, last, n, until = self.open.get() if self.open.exists() else (times[0], times[0], 0, None)
        if until is not None:
            self.handle.deleteTimer(_timer(until))
        for t in times:
            if n and t - last >= self.quiet:  # of rows that come together, some may close a period
                out.append(self.told(key, first, last, n))
                first, n = t, 0
            first, last, n = min(first, t), max(last, t), n + 1
        until = last + self.quiet
        self.handle.registerTimer(_timer(until))
        self.open.update((first, last, n, until))
        return iter(out)

    def told(self, key, first, last, n) -> Row:
        return Row(key=key[0], first=_moment(first), last=_moment(last), n=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            first, last, n, until = self.open.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= _timer(until):
                self.open.clear()
                yield self.told(key, first, last, n)

    def close(self) -> None:
        pass


def quiet_keys(stream: DataFrame, key: str, quiet_s: float = QUIET_S, time: str | None = None, late: str = "1 minute") -> DataFrame:
    """(key, first, last, n), appended when a key has been quiet for so long.

    Without `time`, times are those at which rows come, and a timer of the clock tells the quiet: a key comes out
    though nothing else ever happens. With the name of a timestamp column, times are the rows' own, a period is
    told once the watermark passes its end, and rows later than `late` are dropped.
    """
    from pyspark.sql import functions as F

    with_state(stream.sparkSession)
    keyed = stream.select(F.col(key).cast("string").alias("key"), *([F.col(time).alias("at")] if time else [])).where("key is not null")
    if time:
        keyed = keyed.where("at is not null").withWatermark("at", late)
    made = keyed.groupBy("key").transformWithState(_Quiet(round(quiet_s * 1_000_000), time is not None), "key string, first timestamp_ntz, last timestamp_ntz, n long", "Append", "EventTime" if time else "ProcessingTime")
    return made


#: Where rows wait, and may be pruned.
_WAITING = ("failed", "pending")
#: Parts that a path's rows are kept in, each one value of the state: every read or write of one is a call to the JVM, which costs far more than the rows in it.
PARTS = 16
#: What a queue's stream tells of each step: the row after it, null status once it is gone. n: rises from step to step of a path.
STEPS = "path string, sha256 string, n long, event string, status string, attempts int, last_error string, at timestamp_ntz, next_attempt_at timestamp_ntz, enqueued_at timestamp_ntz"


def _part(sha: str) -> int:
    return zlib.crc32(sha.encode()) % PARTS


class _Queue(StatefulProcessor):
    """The rows of one path, by digest: pending, in_flight, done or failed. See work_queue.

    A path's rows are read once for what comes for it in a batch, and once for all waits that end in one: it has a
    single timer, for the first of them. They are kept by parts of digests, as JSON, and changed parts are written. What a done row prunes is found by a heap of waiting rows by their time.
    """

    def __init__(self, by_event_time: bool, attempts: int, lease: int, kept: int):
        self.by_event_time, self.most, self.lease, self.kept = by_event_time, attempts, lease, kept

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part int", "rows string")
        self.count = handle.getValueState("count", "n long, timer long")

    def wake(self, row: tuple) -> int | None:
        """When time alone changes the row, in milliseconds."""
        status, _, _, next_at, _, updated, due = row
        at = {"pending": None if due else next_at, "in_flight": updated + self.lease, "done": updated + self.kept}.get(status)
        return None if at is None else _timer(at)

    def step(self, path: str, sha: str, event: str, row: tuple | None, now: int, before: tuple | None = None) -> Row:
        """Keeps the row (or drops it), and tells the step."""
        self.n += 1
        self.touched.add(sha)
        if row is None:
            del self.mine[sha]
            self.failed.pop(sha, None)
            status, attempts, error, next_at, enqueued = None, before[1], before[2], None, before[4]
        else:
            old = self.mine.get(sha)
            self.mine[sha] = row
            status, attempts, error, next_at, enqueued = row[:5]
            if status == "failed":
                self.failed[sha] = None
            else:
                self.failed.pop(sha, None)
            if self.waiting is not None and status in _WAITING and (old is None or old[0] not in _WAITING):
                heapq.heappush(self.waiting, (enqueued, self.n, sha))
        return Row(path=path, sha256=sha, n=self.n, event=event, status=status, attempts=attempts, last_error=error, at=_moment(now), next_attempt_at=None if next_at is None else _moment(next_at), enqueued_at=_moment(enqueued))

    def load(self, timerValues) -> None:
        """The path's rows, read once for all that is done to them now. Steps are numbered from the clock on, so that a path that was empty in between goes on above its old numbers."""
        self.n, self.timer = self.count.get() or (timerValues.getCurrentProcessingTimeInMs() * 1000, None)
        stored = {k[0]: json.loads(v[0]) for k, v in self.parts.iterator()}
        self.mine, self.touched, self.stored = {sha: tuple(row) for rows in stored.values() for sha, *row in rows}, set(), set(stored)
        self.failed, self.waiting = {sha: None for sha, row in self.mine.items() if row[0] == "failed"}, None

    def older(self, enqueued: int) -> Iterator[tuple[str, tuple]]:
        """Waiting rows that were entered strictly before, each taken off the heap. Entries of rows that no longer wait are passed over; such a row is put there again once it waits."""
        if self.waiting is None:
            self.waiting = [(row[4], k, sha) for k, (sha, row) in enumerate(self.mine.items()) if row[0] in _WAITING]
            heapq.heapify(self.waiting)
        while self.waiting and self.waiting[0][0] < enqueued:
            at, _, sha = heapq.heappop(self.waiting)
            row = self.mine.get(sha)
            if row and row[0] in _WAITING and row[4] == at:
                yield sha, row

    def save(self) -> None:
        changed = {_part(sha): [] for sha in self.touched}
        for sha, row in self.mine.items():
            if (part := _part(sha)) in changed:
                changed[part].append((sha, *row))
        for part, rows in changed.items():
            if rows:
                self.parts.updateValue((part,), (json.dumps(rows),))
            elif part in self.stored:
                self.parts.removeKey((part,))
        wake = min((x for x in map(self.wake, self.mine.values()) if x is not None), default=None)
        if wake != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        if self.mine:
            self.count.update((self.n, wake))
        else:
            self.count.clear()

    def command(self, path: str, r, now: int) -> Iterator[Row]:
        sha, what = r["sha256"], r["command"]
        old = self.mine.get(sha)
        if what == "enqueue" and old is None:
            yield self.step(path, sha, "enqueued", ("pending", 0, None, now, now, now, True), now)
        elif what == "requeue":
            yield self.step(path, sha, "requeued" if old else "enqueued", ("pending", 0, None, now, old[4] if old else now, now, True), now)
        elif what == "claim" and old and old[0] == "pending" and old[3] <= now:
            yield self.step(path, sha, "claimed", ("in_flight", *old[1:5], now, False), now)
        elif what == "done" and old:
            yield self.step(path, sha, "done", ("done", *old[1:5], now, False), now)
            for other, row in self.older(old[4]):
                yield self.step(path, other, "pruned", None, now, row)
        elif what == "failed" and old:
            tried = old[1] + 1
            wait = round(1_000_000 * min(FIRST_WAIT_S * 2.0**tried, LONGEST_WAIT_S))
            yield self.step(path, sha, "failed" if tried >= self.most else "retry", ("failed" if tried >= self.most else "pending", tried, (r["error"] or "")[:ERROR_CHARS], now + wait, old[4], now, False), now)
        elif what == "delete":
            for other, row in list(self.mine.items()):
                yield self.step(path, other, "deleted", None, now, row)
        elif what == "reset":
            for other in list(self.failed):
                row = self.mine[other]
                yield self.step(path, other, "reset", ("pending", 0, row[2], now, row[4], now, True), now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.load(timerValues)
        clock = timerValues.getCurrentProcessingTimeInMs() * 1000
        asked = [(_us(r["at"]) if self.by_event_time else clock, r["nth"], k, r) for k, r in enumerate(rows)]
        out = [x for now, _, _, r in sorted(asked, key=lambda a: a[:3]) for x in self.command(key[0], r, now)]
        self.save()
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All that is over by the batch's clock, in the order of its times, each step at its own."""
        expired = expiredTimerInfo.getExpiryTimeInMs()
        until = max(expired, timerValues.getCurrentWatermarkInMs() if self.by_event_time else timerValues.getCurrentProcessingTimeInMs())
        self.load(timerValues)
        self.timer = None if self.timer == expired else self.timer  # that one is spent
        over, out = [], []
        for sha, row in self.mine.items():
            ms = self.wake(row)
            if ms is not None and ms <= until:
                heapq.heappush(over, (ms, sha))
        while over:
            ms, sha = heapq.heappop(over)
            status, attempts, error, next_at, enqueued, updated, _ = row = self.mine[sha]
            if status == "pending":
                out.append(self.step(key[0], sha, "due", ("pending", attempts, error, next_at, enqueued, updated, True), ms * 1000))
            elif status == "in_flight":
                out.append(self.step(key[0], sha, "released", ("pending", attempts, error, next_at, enqueued, ms * 1000, True), ms * 1000))
            else:
                out.append(self.step(key[0], sha, "expired", None, ms * 1000, row))
        self.save()
        return iter(out)

    def close(self) -> None:
        pass


def work_queue(commands: DataFrame, by_event_time: bool = False, late: str = "0 seconds", attempts: int = ATTEMPTS, lease_s: int = LEASE_S, kept_s: int = KEPT_S) -> DataFrame:
    """The steps of a queue (STEPS) that a stream of commands and the passing of time make.

    commands: path, sha256, command, error, and nth and at, which order those of a path that come together.
    enqueue takes an item that isn't there yet, requeue any; claim takes a due one; done ends one and prunes
    strictly older waiting or failed versions of its path; failed lets it wait for 0.5 * 2**n seconds after the
    n-th time, 1800 at most, and gives up at `attempts`; reset takes up failed ones of the path; delete drops the
    path. Timers tell when a wait is over (due), a claim outlived its lease (released) and a done row was kept
    long enough (expired). State is split by path; commands on rows that aren't there, null paths and digests
    do nothing. by_event_time: `at` and its watermark are the clock, else the machine's.
    """
    with_state(commands.sparkSession)
    known = commands.where("path is not null and command is not null and at is not null and (sha256 is not null or command in ('reset', 'delete'))").select("path", "sha256", "command", "error", "nth", "at")
    keyed = known.withWatermark("at", late) if by_event_time else known
    processor = _Queue(by_event_time, attempts, lease_s * 1_000_000, kept_s * 1_000_000)
    return keyed.groupBy("path").transformWithState(processor, STEPS, "Append", "EventTime" if by_event_time else "ProcessingTime")


def queue_now(steps: DataFrame) -> DataFrame:
    """path, sha256, status, attempts, last_error, next_attempt_at, enqueued_at of the rows that are there after all steps: the last one of each tells."""
    from pyspark.sql import functions as F

    names = ["status", "attempts", "last_error", "next_attempt_at", "enqueued_at"]
    last = steps.groupBy("path", "sha256").agg(F.max_by(F.struct(*names), "n").alias("s"))
    return last.select("path", "sha256", "s.*").where("status is not null")
