"""Sources by name: where a tool's files lie and how their lines become events. Others can be registered beside those known."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.sources import ranges, store, transcripts, turn_logs


@dataclass(frozen=True)
class Source:
    """name; folders below its root; names of its files; lines (file, line_no, line) to events, or None if there are none (files are only listed)."""

    name: str
    folders: tuple[str, ...] = ("",)
    glob: str = "*.jsonl"
    events: Callable[[DataFrame], DataFrame] | None = None
    excluded: tuple[str, ...] = tuple(store.EXCLUDED)

    def paths(self, root: str) -> list[str]:
        return [f"{root.rstrip('/')}/{f}".rstrip("/") for f in self.folders]

    def files(self, spark: SparkSession, root: str) -> DataFrame:
        """(source, path, modified_at, bytes) of its files in all folders."""
        found = reduce(DataFrame.unionAll, [store.discovered(spark, p, self.glob, list(self.excluded)) for p in self.paths(root)])
        return found.select(F.lit(self.name).alias("source"), "path", "modified_at", "bytes")

    def lines(self, spark: SparkSession, root: str) -> DataFrame:
        """(file, line_no, line) of its files in all folders and those below them. Excluded names aren't opened."""
        if ranges.opened_by_pyarrow(root):
            return ranges.read_lines(spark, self.paths(root), self.glob, self.excluded)
        bad = F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, self.excluded)).cast("array<string>"))
        return reduce(DataFrame.unionAll, [transcripts.read_lines(spark, p, self.glob) for p in self.paths(root)]).where(~bad)

    def tail(self, spark: SparkSession, root: str) -> DataFrame:
        """A stream of (file, at, line): what is there and what is appended; at is the line's place in bytes."""
        return ranges.tail_lines(spark, self.paths(root), self.glob, self.excluded)

    def read(self, spark: SparkSession, root: str) -> DataFrame:
        """Its events; ValueError if its files have none."""
        if self.events is None:
            raise ValueError(f"{self.name} has no events")
        return self.events(self.lines(spark, root))


_KNOWN: dict[str, Source] = {}


def register(source: Source) -> Source:
    """From now on the source is known by its name; it takes the place of one with the same name."""
    _KNOWN[source.name] = source
    return source


def named(name: str) -> Source:
    if name not in _KNOWN:
        raise KeyError(f"no source {name}; there are {', '.join(sorted(_KNOWN))}")
    return _KNOWN[name]


register(Source("blocks", events=transcripts.block_events))
register(Source("rows", events=turn_logs.row_events))
register(Source("desktop", folders=("desktop", "desktop-sessions"), events=transcripts.block_events))
register(Source("raw", glob="*.{jsonl,txt}"))
