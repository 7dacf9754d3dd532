"""Versioned tables in a folder: data files, and a manifest for each version that tells which of them it has.

A write puts its data into a folder of its own and then adds the next manifest, by a rename that fails if another
writer was first; it then starts over from the version that won. Readers hold on to the version that they opened. A
write that dies leaves data that no manifest names. Manifests are as atomic as the store's rename.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.operators import sessions as S

#: Times that a write starts over.
ATTEMPTS = 20


class Conflict(Exception):
    """Another writer committed this version."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: str
    parts: tuple[str, ...]

    def text(self) -> str:
        return json.dumps({"version": self.number, "schema": self.schema, "parts": self.parts})


class VersionedTable:
    """A table whose versions are numbered from 1. Before the first there is none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        top = self.path(self.folder)
        self.files = top.getFileSystem(spark._jsc.hadoopConfiguration())
        self.top = self.files.makeQualified(top).toString()

    def _place(self, name: str):
        return self.path(f"{self.top}/{name}")

    def versions(self) -> list[int]:
        log = self._place("log")
        names = [s.getPath().getName() for s in self.files.listStatus(log)] if self.files.exists(log) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version | None:
        """The version of that number, or the last; None if there is none yet."""
        known = self.versions()
        if number is None and not known:
            return None
        if number is not None and number not in known:
            raise KeyError(f"no version {number}; there are {known}")
        stream = self.files.open(self._place(f"log/{number or known[-1]:012d}.json"))
        try:
            told = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Version(told["version"], told["schema"], tuple(told["parts"]))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last one if no number is given; what is committed later doesn't show."""
        found = self.version(number)
        if found is None:
            raise KeyError(f"{self.folder} has no version yet")
        return self._rows(found)

    def _rows(self, version: Version) -> DataFrame:
        reader = self.spark.read.schema(version.schema)
        return reader.parquet(*(f"{self.top}/{p}" for p in version.parts)) if version.parts else self.spark.createDataFrame([], version.schema)

    def _written(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.top}/{name}")
        return name

    def commit(self, version: Version) -> None:
        """Adds the manifest; Conflict if there is one of its number."""
        beside, place = self._place(f"log/.{uuid.uuid4().hex}"), self._place(f"log/{version.number:012d}.json")
        out = self.files.create(beside, False)
        out.write(bytearray(version.text().encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(beside, place, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            self.files.delete(beside, False)
            if self.files.exists(place):
                raise Conflict(str(version.number)) from error
            raise

    def _changed(self, change: Callable[[Version | None], Version]) -> int:
        for _ in range(ATTEMPTS):
            made = change(self.version())
            try:
                self.commit(made)
                return made.number
            except Conflict:
                continue
        raise Conflict(f"{ATTEMPTS} times another writer was first")

    def append(self, rows: DataFrame) -> int:
        """The rows besides those that are there; gives the version's number. Data is written once, whoever else commits in between. A first append tells the schema, later ones must have its columns."""
        written: list[str] = []

        def change(last: Version | None) -> Version:
            if last is None:
                schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
            else:
                schema = last.schema
            if not written:
                kept = rows if last is None else rows.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in self._rows(last).schema))
                written.append(self._written(kept))
            return Version(last.number + 1 if last else 1, schema, (*(last.parts if last else ()), *written))

        return self._changed(change)

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """What change makes of the last version's rows, as a new version; made anew from what another writer committed meanwhile."""

        def made(last: Version | None) -> Version:
            if last is None:
                raise KeyError(f"{self.folder} has no version yet")
            return Version(last.number + 1, last.schema, (self._written(change(self._rows(last))),))

        return self._changed(made)

    def delete(self, condition: str) -> int:
        """Without the rows that meet the condition (SQL; unknown counts as not met)."""
        return self.rewrite(lambda rows: rows.where(~F.coalesce(F.expr(condition), F.lit(False))))

    def upsert(self, rows: DataFrame, key: Sequence[str]) -> int:
        """The rows in place of those with the same key, and besides the others."""
        return self.rewrite(lambda old: old.join(rows.select(*key).distinct(), list(key), "left_anti").select(*old.columns).unionByName(rows.select(*old.columns)))

    def compact(self, parts: int = 1) -> int:
        """The same rows in few files. A part that was appended meanwhile is kept as it is."""
        base = self.version()
        if base is None:
            raise KeyError(f"{self.folder} has no version yet")
        whole = self._written(self._rows(base).repartition(parts))

        def change(last: Version | None) -> Version:
            if not set(base.parts) <= set(last.parts):
                raise Conflict("rewritten meanwhile")
            return Version(last.number + 1, last.schema, (whole, *(p for p in last.parts if p not in base.parts)))

        return self._changed(change)


class SessionStore(Protocol):
    """What a store of sessions has: sessions (id, last_active and more) and events (session_id, seq and more)."""

    def sessions(self) -> DataFrame: ...

    def events(self, session: str) -> DataFrame: ...


class VersionedSessions:
    """A session store over two versioned tables. The index may trail the events: a session's row is what was written last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.index, self.log = VersionedTable(spark, f"{folder}/sessions"), VersionedTable(spark, f"{folder}/events")

    def create(self, sessions: DataFrame, events: DataFrame) -> None:
        """New sessions with their events; the events come first, so that no session is told without them."""
        self.log.append(events)
        self.index.append(sessions)

    def append(self, events: DataFrame, touched: DataFrame | None = None) -> None:
        """More events; touched: the rows of their sessions as they are from now on, else the index stays as it is."""
        self.log.append(events)
        if touched is not None:
            self.index.append(touched)

    def delete(self, session: str) -> None:
        for table, column in ((self.index, "id"), (self.log, "session_id")):
            table.rewrite(lambda rows, column=column: rows.where(~F.col(column).eqNullSafe(F.lit(session))))

    def sessions(self) -> DataFrame:
        return S.latest(self.index.read(), "id", ["last_active"])

    def events(self, session: str) -> DataFrame:
        return self.log.read().where(F.col("session_id") == session)


class ChainedStores:
    """Stores over one another: of a session that several have, the first one's row and events count."""

    def __init__(self, *stores: SessionStore):
        self.stores = stores

    def sessions(self) -> DataFrame:
        return S.first_store_wins([s.sessions() for s in self.stores], "id")

    def page(self, limit: int = 50, cursor: str | None = None) -> DataFrame:
        return S.merged_page([s.sessions() for s in self.stores], limit, cursor)

    def get(self, prefix: str) -> str:
        """The id that is this or the only one that begins so; KeyError if none does, ValueError if several do."""
        found = [r.id for r in reduce(DataFrame.unionAll, [s.sessions().where(F.col("id").startswith(prefix)).select("id") for s in self.stores]).distinct().orderBy("id").limit(2).collect()]
        if prefix in found:
            return prefix
        if not found:
            raise KeyError(prefix)
        if len(found) > 1:
            raise ValueError(f"{prefix} begins several ids: {', '.join(found)}, ...")
        return found[0]

    def events(self, session: str) -> DataFrame:
        for store in self.stores:
            if not store.sessions().where(F.col("id") == session).isEmpty():
                return store.events(session)
        raise KeyError(session)
