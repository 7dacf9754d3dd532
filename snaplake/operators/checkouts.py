"""Sessions made ready to go on: replayed, compacted, with a head; local stores of sessions; where their repositories lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.operators import sessions

#: Session buckets of a store: files hold many sessions each.
BUCKETS = 64


def checked_out(chains: DataFrame, events: DataFrame, starts: DataFrame, budget: int, session_col: str = "session", seq_col: str = "seq", type_col: str = "type", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(events, index) of the sessions in chains (see sessions.ancestors), as another tool goes on with them.

    Each chain is replayed from its root, compacted to the budget, and begins with its session_start from
    starts (id, text) unless the replay has one. events: id, place (from 1), type, text; index: id,
    event_count, dropped (events that compaction left out).
    """
    whole = sessions.replay(chains, events, session_col, seq_col).select(F.col("id").alias("_id"), "place", type_col, text_col)
    begun = whole.where(F.col(type_col) == "session_start").select("_id").distinct()
    heads = starts.select(F.col("id").alias("_id"), F.lit(0).alias("place"), F.lit("session_start").alias(type_col), F.col("text").alias(text_col))
    heads = heads.join(begun, "_id", "left_anti").join(chains.select(F.col("id").alias("_id")).distinct(), "_id", "left_semi")
    rows = heads.unionByName(whole)
    kept, dropped = sessions.compacted(rows, "_id", "place", sessions.token_estimate(F.col(text_col)), budget, type_col=type_col, text_col=text_col)
    out = kept.select(F.col("_id").alias("id"), "place", F.col(type_col).alias("type"), F.col(text_col).alias("text"))
    index = out.groupBy("id").agg(F.count("*").alias("event_count")).join(dropped.select(F.col("_id").alias("id"), F.col("n_dropped").alias("dropped")), "id", "left")
    return out, index.withColumn("dropped", F.coalesce("dropped", F.lit(0)))


def write_store(index: DataFrame, events: DataFrame, folder: str, session_col: str = "session", buckets: int = BUCKETS) -> None:
    """Writes a store: index and events as Parquet, events in buckets of sessions, so that a session is read from one bucket."""
    index.write.mode("overwrite").parquet(f"{folder}/index")
    dealt = events.withColumn("bucket", F.pmod(F.xxhash64(session_col), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/events")


def read_session(spark, folder: str, session, session_col: str = "session", buckets: int = BUCKETS) -> DataFrame:
    """The events of one session of a store: its bucket alone is read."""
    rows = spark.read.parquet(f"{folder}/events")
    kind = rows.schema[session_col].dataType
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(session).cast(kind)), F.lit(buckets)).cast("int")).first()[0]
    return rows.where((F.col("bucket") == bucket) & (F.col(session_col) == F.lit(session).cast(kind))).drop("bucket")


def is_checkout(first_line: Column, marker: str) -> Column:
    """A transcript's first line is a JSON object with the field that marks written checkouts."""
    return F.coalesce(F.get_json_object(first_line, f"$.{marker}").isNotNull(), F.lit(False))


def resolved(rows: DataFrame, registry: DataFrame, scanned: DataFrame) -> DataFrame:
    """rows (id, repo_url, origin_cwd) with folder and found_by: the registry's folder of the repository that was seen last, else the first one scanned, else the session's own; null if there is none.

    registry: (repo_url, folder, last_seen); scanned: (repo_url, folder). Repositories are compared as they are: normalise both sides before.
    """
    last = registry.groupBy("repo_url").agg(F.max(F.struct("last_seen", "folder")).alias("f")).select("repo_url", F.col("f.folder").alias("known"))
    first = scanned.groupBy("repo_url").agg(F.min("folder").alias("there"))
    out = rows.join(last, "repo_url", "left").join(first, "repo_url", "left")
    by = F.when(F.col("known").isNotNull(), "registry").when(F.col("there").isNotNull(), "scan").when(F.col("origin_cwd").isNotNull(), "origin")
    return out.select(*rows.columns, F.coalesce("known", "there", "origin_cwd").alias("folder"), by.alias("found_by"))
