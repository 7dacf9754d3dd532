"""Lines of files by byte ranges, as a data source: for batches, and for tails of files that grow.

A range owns the lines that start in it, however long they are, so that a large file is read by many tasks and
each line by one. Folders are walked as names only: what is excluded is never opened. A last line without its
end is held back until it has one. Files are opened with pyarrow, which knows local paths and the usual stores.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range and of one read; rows and bytes of a batch.
RANGE_BYTES, CHUNK, BATCH_ROWS, BATCH_BYTES = 128_000_000, 1_000_000, 10_000, 8_000_000
#: Kinds of addresses that pyarrow opens.
SCHEMES = ("file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def opened_by_pyarrow(path: str) -> bool:
    scheme = re.match(r"(\w+):", path)
    return scheme is None or scheme[1] in SCHEMES


def filesystem(path: str):
    """(filesystem, path in it, what stands before a path in an address)."""
    from pyarrow import fs

    scheme = re.match(r"(\w+):", path)
    if scheme is None or scheme[1] == "file":
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", path).lstrip("/"), "file://"
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner, path[: len(path) - len(inner.lstrip("/"))].rstrip("/") + "/" * (not inner.startswith("/"))


def matchers(glob: str) -> list[str]:
    """The patterns of a glob with one set of braces: *.{a,b} is *.a and *.b."""
    found = re.match(r"(.*)\{([^}]*)\}(.*)", glob)
    return [f"{found[1]}{x}{found[3]}" for x in found[2].split(",")] if found else [glob]


def walked(root: str, glob: str, excluded: frozenset[str]) -> Iterator[tuple[str, int]]:
    """(address, bytes) of the files below root whose names match, in order; excluded names aren't gone into. No root: none."""
    from pyarrow import fs

    store, top, before = filesystem(root)
    patterns = matchers(glob)
    if excluded & set(top.split("/")):
        return

    def below(folder: str):
        for info in sorted(store.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda x: x.path):
            name = info.path.rsplit("/", 1)[-1]
            if name in excluded:
                continue
            if info.type == fs.FileType.Directory:
                yield from below(info.path)
            elif info.type == fs.FileType.File and any(fnmatchcase(name, p) for p in patterns):
                yield before + info.path, info.size

    info = store.get_file_info(top)
    if info.type == fs.FileType.File:
        yield before + top, info.size
    else:
        yield from below(top.rstrip("/"))


def complete_until(file, since: int, size: int) -> int:
    """The place after the last line end from `since` up to `size`; `since` if there is none. Reads from the end."""
    upto = size
    while upto > since:
        low = max(since, upto - CHUNK)
        file.seek(low)
        at = file.read(upto - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        upto = low
    return since


def lines_of(file, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the lines that start from `start` up to before `end` and have their end before `size`."""
    at = start
    file.seek(max(start - 1, 0))
    place = max(start - 1, 0)
    skipping, held = start > 0, []  # held: parts of a line whose end wasn't read yet
    while place < size:
        chunk = file.read(min(CHUNK, size - place))
        if not chunk:
            return
        low = 0
        if skipping:
            low = chunk.find(b"\n") + 1
            if not low:
                place += len(chunk)
                continue
            skipping, at = False, place + low
        if not held and at >= end:
            return
        *whole, rest = chunk[low:].split(b"\n")
        for part in whole:
            line = b"".join([*held, part]) if held else part
            held = []
            yield at, line
            at += len(line) + 1
            if at >= end:
                return
        if rest:
            held.append(rest)
        place += len(chunk)


@dataclass
class ByteRange:
    """Bytes from start up to before end of a file that has `size` bytes to be read."""

    file: str
    start: int
    end: int
    size: int


def cut(file: str, start: int, size: int, step: int) -> list[ByteRange]:
    return [ByteRange(file, a, min(a + step, size), size) for a in range(start, size, step)]


@dataclass
class Pack(InputPartition):
    """What one task reads: a range, or several small ones."""

    ranges: list[ByteRange]


def packed(found: list[ByteRange], step: int) -> list[Pack]:
    """The ranges in order, as many in a pack as come to `step` bytes, each counted with a share for opening its file. None: one empty pack."""
    out, weight = [Pack([])], 0
    for r in found:
        weight += r.end - r.start + min(step // 32, 4_000_000)
        if weight > step and out[-1].ranges:
            out.append(Pack([]))
            weight = r.end - r.start
        out[-1].ranges.append(r)
    return out


def rows_of(pack: Pack) -> Iterator[pa.RecordBatch]:
    for r in pack.ranges:
        yield from batches(r)


def _text(values: list[bytes]) -> pa.Array:
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values])


def batches(part: ByteRange) -> Iterator[pa.RecordBatch]:
    """file, start (of the range), nth (from 1 within it, blank lines count), at (place of the line), line."""
    store, inner, _ = filesystem(part.file)
    names = ["file", "start", "nth", "at", "line"]
    with store.open_input_file(inner) as file:
        held, weight, nth = [], 0, 0

        def told():
            n = len(held)
            return pa.record_batch([pa.array([part.file] * n), pa.array([part.start] * n, pa.int64()), pa.array(range(nth - n + 1, nth + 1), pa.int64()), pa.array([a for a, _ in held], pa.int64()), _text([x for _, x in held])], names=names)

        for at, line in lines_of(file, part.start, part.end, part.size):
            nth += 1
            held.append((at, line))
            weight += len(line)
            if len(held) >= BATCH_ROWS or weight >= BATCH_BYTES:
                yield told()
                held, weight = [], 0
        if held:
            yield told()


class _Options:
    def __init__(self, options):
        self.roots = json.loads(options["roots"]) if "roots" in options else [options["path"]]
        self.glob = options.get("glob", "*.jsonl")
        self.excluded = frozenset(json.loads(options.get("excluded", "[]")))
        self.step = int(options.get("rangeBytes", RANGE_BYTES))

    def files(self) -> Iterator[tuple[str, int]]:
        for root in self.roots:
            yield from walked(root, self.glob, self.excluded)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return packed([r for file, size in self.options.files() for r in cut(file, 0, size, self.options.step)], self.options.step)

    def read(self, partition):
        return rows_of(partition)


class _Tail(DataSourceStreamReader):
    """Offsets are maps from a file to the place up to which its lines are read."""

    def __init__(self, options):
        self.options, self.known, self.sizes = options, {}, {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        now = {}
        for file, size in self.options.files():
            if self.sizes.get(file) != size:
                store, inner, _ = filesystem(file)
                since = self.known.get(file, 0)
                with store.open_input_file(inner) as f:
                    self.known[file] = complete_until(f, since if since <= size else 0, size)
                self.sizes[file] = size
            now[file] = self.known[file]
        return now

    def partitions(self, start, end):
        # a file that is shorter than what was read of it has been written anew
        fresh = [(f, start.get(f, 0) if start.get(f, 0) <= upto else 0, upto) for f, upto in sorted(end.items())]
        return packed([r for f, since, upto in fresh for r in cut(f, since, upto, self.options.step)], self.options.step)

    def read(self, partition):
        return rows_of(partition)


class LineRanges(DataSource):
    """Format line_ranges. Options: path, or roots (a JSON list of paths); glob of file names (one set of braces); excluded (a JSON list of names); rangeBytes."""

    @classmethod
    def name(cls):
        return "line_ranges"

    def schema(self):
        return "file string, start long, nth long, at long, line string"

    def reader(self, schema):
        return _Batch(_Options(self.options))

    def streamReader(self, schema):
        return _Tail(_Options(self.options))


def _configured(reader, roots: list[str], glob: str, excluded, range_bytes: int):
    return reader.format("line_ranges").options(roots=json.dumps(list(roots)), glob=glob, excluded=json.dumps(sorted(excluded)), rangeBytes=str(range_bytes))


def read_ranges(spark: SparkSession, roots: list[str], glob: str = "*.jsonl", excluded=(), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, start, nth, at, line) of all lines below the roots that have their end."""
    spark.dataSource.register(LineRanges)
    return _configured(spark.read, roots, glob, excluded, range_bytes).load()


def read_lines(spark: SparkSession, roots: list[str], glob: str = "*.jsonl", excluded=(), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, line_no, line) of the lines below the roots; blank ones count but are left out.

    Lines are numbered within their range as they are read, and the ranges of a file are counted in a first pass:
    no line is shuffled or sorted. Numbers are the same whatever the size of the ranges.
    """
    rows = read_ranges(spark, roots, glob, excluded, range_bytes)
    counts = rows.groupBy("file", "start").agg(F.max("nth").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.join(counts.select("file", "start", F.coalesce(before, F.lit(0)).alias("before")), ["file", "start"])
    return placed.where("line <> ''").select("file", (F.col("before") + F.col("nth")).cast("int").alias("line_no"), "line")


def tail_lines(spark: SparkSession, roots: list[str], glob: str = "*.jsonl", excluded=(), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of (file, at, line): lines of files that are there and bytes that are appended to them, each once.

    The checkpoint holds for every file the place up to which it was read. Blank lines are left out. A file that
    is found shorter than what was read of it counts as written anew and is read from its start.
    """
    spark.dataSource.register(LineRanges)
    rows = _configured(spark.readStream, roots, glob, excluded, range_bytes).load()
    return rows.where("line <> ''").select("file", "at", "line")


def write_lines(rows: DataFrame, folder: str) -> int:
    """Writes rows (file: path below the folder, nth, line) as text files, whole and in order of nth; gives their number.

    A file is written beside its place by one task and then moved there, so that readers see the old or the new
    one and a task that runs again does no harm.
    """

    def run(parts):
        import uuid

        store, top, _ = filesystem(folder)
        now = out = None
        written = 0

        def closed():
            nonlocal out, written
            if out is not None:
                out.close()
                store.move(beside, f"{top}/{now}")
                out, written = None, written + 1

        for batch in parts:
            for name, line in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist()):
                if name != now:
                    closed()
                    now, beside = name, f"{top}/{name}.{uuid.uuid4().hex}.part"
                    store.create_dir(f"{top}/{name}".rsplit("/", 1)[0])
                    out = store.open_output_stream(beside)
                out.write((line or "").encode() + b"\n")
        closed()
        yield pa.record_batch([pa.array([written], pa.int64())], names=["n"])

    ordered = rows.select("file", "nth", "line").repartition("file").sortWithinPartitions("file", "nth")
    return ordered.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
