"""Snapshots: named, immutable sets of tables."""

from __future__ import annotations

import tempfile
from collections import ChainMap
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.operators.query import Query

#: Keys of the known tables; tables without one are compared as multisets.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}


@lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one for a local master; ValueError on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir isn't set, and executors don't share a local folder")
    return _local_folder()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder, so that a lost executor costs only its own tasks.

    Spark drops the files with the frame if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


class Folder(Mapping):
    """The tables of a folder of Parquet files by name; a table's files are looked at when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str, names: list[str]):
        self.spark, self.folder, self.names, self.read = spark, folder, names, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name not in self.read:
            self.read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.read[name]

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def __contains__(self, name) -> bool:
        return name in self.names


@dataclass(frozen=True)
class Snapshot:
    """Tables by name, with the key columns of those that have any. Nothing is read before a query asks."""

    spark: SparkSession
    frames: Mapping[str, DataFrame]
    keys: Mapping[str, list[str]] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, folder: str, names: list[str] | None = None) -> Snapshot:
        names = names or [*KEYS, "lineitem"]
        return cls(spark, Folder(spark, folder, names), {n: KEYS[n] for n in names if n in KEYS})

    def tables(self) -> list[str]:
        return sorted(self.frames)

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise KeyError(f"no table {name}; there are {', '.join(self.tables())}")
        return self.frames[name]

    def table(self, name: str) -> Query:
        return Query(self, name)

    def replace(self, **frames: DataFrame) -> Snapshot:
        """The snapshot after a write: a new one, with these tables in place of its own."""
        return Snapshot(self.spark, ChainMap(frames, self.frames), self.keys)

    def by_key(self, name: str, *keys) -> DataFrame:
        """The rows of a table with these keys (of several key columns: tuples); the filter reaches the scan."""
        columns = self.keys[name]
        wanted = [k if isinstance(k, tuple) else (k,) for k in keys]
        hit = F.lit(False)
        for values in wanted if len(columns) > 1 else []:
            here = F.lit(True)
            for c, v in zip(columns, values, strict=True):
                here = here & (F.col(c) == F.lit(v))
            hit = hit | here
        return self.frame(name).where(hit if len(columns) > 1 else F.col(columns[0]).isin([v for (v,) in wanted]))

    def write(self, name: str, insert: DataFrame | None = None, update: Mapping[str, str] | None = None, delete: bool = False, where: str = "true") -> tuple[Snapshot, int]:
        """A new snapshot after one write, and the rows that it concerns: rows inserted, or those that meet `where` updated (column: SQL expression) or deleted."""
        rows = self.frame(name)
        if insert is not None:
            return self.replace(**{name: rows.unionByName(insert, allowMissingColumns=True)}), insert.count()
        hit = F.coalesce(F.expr(where), F.lit(False))
        n = rows.where(hit).count()
        if delete:
            return self.replace(**{name: rows.where(~hit)}), n
        changed = {c: F.when(hit, F.expr(e)).otherwise(F.col(c)).cast(rows.schema[c].dataType) for c, e in (update or {}).items()}
        return self.replace(**{name: rows.withColumns(changed)}), n

    def sql(self, text: str, args: Mapping | None = None) -> DataFrame:
        """SQL over the tables, as views of this session; named parameters as :name."""
        for name, frame in self.frames.items():
            frame.createOrReplaceTempView(name)
        return self.spark.sql(text, args=dict(args or {}))

    def describe(self) -> DataFrame:
        """(table_name, position, column_name, data_type, is_key) of every column."""
        rows = [(t, i, c, kind, c in self.keys.get(t, [])) for t in self.tables() for i, (c, kind) in enumerate(self.frames[t].dtypes)]
        return self.spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, is_key boolean")

    def counts(self) -> DataFrame:
        """(table_name, n) of every table: one pass each, all in one job."""
        parts = [self.frames[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in self.tables()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out


class Resources:
    """Snapshots and other resources by address (kind://name); each is made when first asked for."""

    def __init__(self):
        self.makers: dict[str, Callable] = {}
        self.made: dict[str, object] = {}

    def add(self, address: str, maker: Callable) -> None:
        if "://" not in address:
            raise ValueError(f"{address} is no address")
        self.makers[address] = maker

    def get(self, address: str):
        if address not in self.makers:
            raise KeyError(f"no resource {address}; there are {', '.join(sorted(self.makers))}")
        if address not in self.made:
            self.made[address] = self.makers[address]()
        return self.made[address]
