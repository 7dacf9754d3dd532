"""Files as tools leave them: nested transcripts read by source, and a tail of files that grow. The files are written from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from snaplake.catalog import shared_folder
from snaplake.sources import plugins, ranges, versions
from snaplake.streaming import tail

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _transcripts(spark, d):
    """The conversations as block-style rows, a file each, some folders deep: file, nth, line."""
    talk = spark.read.parquet(f"{d}/conversations.parquet")
    block = F.array(F.struct(F.lit("text").alias("type"), "text"))
    row = F.struct(F.col("role").alias("type"), F.concat("conv_id", F.lit("/"), "turn").alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), F.struct("role", block.alias("content")).alias("message"))
    name = F.concat(F.lit("p"), F.col("conv_id") % 5, F.lit("/q"), F.col("conv_id") % 3, F.lit("/"), F.col("conv_id"), F.lit(".jsonl"))
    return talk.select(name.alias("file"), F.col("turn").alias("nth"), F.to_json(row).alias("line"))


@query("SELECT conv_id::VARCHAR AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS line_no, CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' WHEN 'system' THEN 'lifecycle' ELSE 'opaque' END AS type, text FROM conversations")
def source_nested_transcripts(spark, d):
    """Every conversation written to a file of its own, two folders deep, and read back as events by the source's name. Files in an excluded folder are not."""
    folder, rows = _folder(spark, "nested"), _transcripts(spark, d)
    hidden = rows.where("nth = 0").withColumn("file", F.concat(F.lit("p0/shell_snapshots/"), F.regexp_extract("file", r"[^/]+$", 0)))
    ranges.write_lines(rows.unionByName(hidden), folder)
    return plugins.named("blocks").read(spark, folder).select("session_id", "line_no", "type", "text")


@query("SELECT conv_id::VARCHAR || '/' || turn AS id, CASE WHEN turn < 2 THEN 0 ELSE 1 END AS run FROM conversations")
def tail_appended_bytes(spark, d):
    """Files of conversations that grow between two runs of one tail: the second run reads what was appended, and no line comes twice."""
    folder, out, state = (_folder(spark, x) for x in ("tailed", "rows", "state"))
    rows = _transcripts(spark, d)
    for run, part in enumerate((rows.where("nth < 2"), rows)):
        ranges.write_lines(part, folder)
        found = plugins.named("blocks").tail(spark, folder).select(F.get_json_object("line", "$.uuid").alias("id"))
        tail.deliver(found, lambda batch, n, run=run: batch.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{out}/run={run}-{n}"), state).awaitTermination()
    return spark.read.schema("id string, run int").option("recursiveFileLookup", "true").parquet(out)


@query("""SELECT 'first' AS seen, event_id, value FROM events WHERE event_id % 3 = 0
  UNION ALL SELECT 'last', event_id, CASE WHEN event_id % 6 = 1 THEN -1.0 ELSE value END FROM events WHERE event_id % 3 <> 2 AND NOT coalesce(event_type = 'click', false)""")
def store_versions(spark, d):
    """A versioned table of events: two appends, rows put in place of others, rows deleted, files merged; its first version, still there, and its last."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "value")
    store = versions.VersionedTable(spark, _folder(spark, "versions"))
    store.append(events.where("event_id % 3 = 0"))
    store.append(events.where("event_id % 3 = 1"))
    store.upsert(events.where("event_id % 6 = 1").withColumn("value", F.lit(-1.0)), ["event_id"])
    store.delete("event_type = 'click'")
    store.compact()
    seen = [store.read(n).select(F.lit(name).alias("seen"), "event_id", "value") for name, n in (("first", 1), ("last", None))]
    return seen[0].unionByName(seen[1])
