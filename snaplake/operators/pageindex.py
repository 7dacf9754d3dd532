"""A stored order for keyset pages: rows in files sorted by (time, id), each with its bounds, so that a page deep in the list opens a few files only.

Rows come in runs, one an append; a run is range-partitioned, so its files don't overlap, while files of different
runs may. A table of bounds has a row a file. For a page, the files that lie wholly after the cursor are taken in
order until they hold a page: the least key that they have bounds it, and only files that reach over that key and
start before the cursor are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.operators import sessions

_PAGES = {"parquet.block.size": 8_000_000, "parquet.page.row.count.limit": 1_000}


def append(rows: DataFrame, folder: str, id_col: str = "id", time_col: str = "last_active", rows_a_file: int = 1_000_000) -> None:
    """Adds rows as one more run. Rows without id are left out; rows without time sort last. Readers see a run once its bounds are there.

    A row of an id that is there already is one more row, as in `sessions.page`.
    """
    spark, run = rows.sparkSession, f"{folder}/rows/run-{uuid.uuid4().hex}"
    order = (F.desc_nulls_last(time_col), F.desc(id_col))
    known = rows.where(F.col(id_col).isNotNull())
    files = max(1, -(-known.count() // rows_a_file))
    known.repartitionByRange(int(files), *order).sortWithinPartitions(*order).write.options(**_PAGES).parquet(run)
    key = F.struct(F.col(time_col).alias("at"), F.col(id_col).alias("id"))
    stored = spark.read.schema(known.schema).parquet(run).select(F.col("_metadata.file_path").alias("file"), key.alias("key"))
    stored.groupBy("file").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).coalesce(1).write.mode("append").parquet(f"{folder}/bounds")


def files_of(spark: SparkSession, folder: str, limit: int, cursor: str | None = None) -> list[str]:
    """The files that the page after the cursor can lie in, at most limit + 1 and those that overlap them."""
    bounds = spark.read.parquet(f"{folder}/bounds")
    rows = max(1, min(200, limit)) + 1
    whole = bounds
    if cursor:
        la, sid = sessions.cursor_place(cursor)
        kind = bounds.schema["low"].dataType
        place = F.struct(F.lit(la).cast(kind["at"].dataType).alias("at"), F.lit(sid).cast(kind["id"].dataType).alias("id"))
        bounds, whole = bounds.where(F.col("low") < place), bounds.where(F.col("high") < place)
    held, least = 0, None
    for r in whole.orderBy(F.desc("low")).select("n", "low").limit(rows).collect():  # a file has a row at least
        held += r.n
        if held >= rows:
            least = r.low
            break
    if least is not None:
        kind = bounds.schema["low"].dataType
        bounds = bounds.where(F.col("high") >= F.struct(F.lit(least["at"]).cast(kind["at"].dataType).alias("at"), F.lit(least["id"]).cast(kind["id"].dataType).alias("id")))
    return sorted(r.file for r in bounds.select("file").collect())


def page(spark: SparkSession, folder: str, limit: int = 50, cursor: str | None = None, id_col: str = "id", time_col: str = "last_active") -> DataFrame:
    """What `sessions.page` gives over all rows: one row more than `limit`, newest first."""
    files = files_of(spark, folder, limit, cursor)
    stored = spark.read.option("recursiveFileLookup", "true").parquet(*(files or [f"{folder}/rows"]))
    return sessions.page(stored, limit, cursor, id_col, time_col)


def compact(spark: SparkSession, folder: str, to: str, id_col: str = "id", time_col: str = "last_active", rows_a_file: int = 1_000_000) -> None:
    """All rows as one run in another folder, whose files don't overlap."""
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
    own, known = (f"_{x}_{uuid.uuid4().hex}" for x in ("own", "known"))
    files = spark.read.parquet(f"{folder}/bounds").select(F.col("file").alias(known))
    told = stored.withColumn(own, F.col("_metadata.file_path")).join(files, F.col(own) == F.col(known), "left_semi").drop(own)
    append(told, to, id_col, time_col, rows_a_file)
