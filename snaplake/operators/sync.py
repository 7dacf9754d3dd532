"""Manifests of files, and the state of a work queue as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_diff(local: DataFrame, remote: DataFrame, removed: bool = False) -> DataFrame:
    """(path, sha256, status): local files that are new or changed; removed: and those that only the remote side has."""
    both = local.select("path", F.col("sha256").alias("here")).join(remote.select("path", F.col("sha256").alias("there")), "path", "full_outer" if removed else "left")
    status = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "removed").otherwise("changed")
    return both.where("not here <=> there").select("path", F.coalesce("here", "there").alias("sha256"), status.alias("status"))


def manifest_root(files: DataFrame, digits: int = 3) -> DataFrame:
    """(n, root): one digest of all files, whatever their order. Digests of buckets (16 to the power of digits, by the path's hash) are hashed in turn, so that no task sees all files."""
    leaf = F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws("\t", "path", "sha256")))), 256)
    part = files.groupBy(F.substring(F.sha2("path", 256), 1, digits).alias("bucket")).agg(leaf.alias("leaf"), F.count("*").alias("n"))
    return part.agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws("\t", "bucket", "leaf")))), 256).alias("root"))


def publish(files: DataFrame, folder: str) -> None:
    """Writes a manifest (path, sha256) with its root; what was there before is replaced as a whole."""
    files.select("path", "sha256").write.mode("overwrite").parquet(f"{folder}/files")
    manifest_root(files).write.mode("overwrite").json(f"{folder}/root")


def published(spark, folder: str) -> tuple[DataFrame, str]:
    """A manifest's files and root."""
    return spark.read.parquet(f"{folder}/files"), spark.read.json(f"{folder}/root").first()["root"]


def upserted(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """rows with the changes' values in place of theirs, where those aren't null, and with the changes' new rows; keys are unique on either side."""
    both = rows.alias("o").join(changes.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(*(F.coalesce(F.col(f"n.`{c}`"), F.col(f"o.`{c}`")).alias(c) if c in changes.columns else F.col(f"o.`{c}`") for c in rows.columns))


def backoff(attempts: Column) -> Column:
    """Seconds until the next attempt."""
    return F.least(F.lit(0.5) * F.pow(F.lit(2.0), attempts), F.lit(1800.0))


def claim(queue: DataFrame, now: Column, n: int) -> DataFrame:
    """(path, sha256): the n oldest pending rows that are due."""
    due = (F.col("status") == "pending") & (F.coalesce(F.col("next_attempt_at"), now) <= now)
    return queue.where(due).orderBy("enqueued_at", "path", "sha256").limit(n).select("path", "sha256")


def after_claim(queue: DataFrame, claimed: DataFrame, now: Column) -> DataFrame:
    """The queue with the claimed rows in flight. Spark broadcasts a claim if its size allows."""
    marked = queue.join(claimed.withColumn("_c", F.lit(True)), ["path", "sha256"], "left")
    return marked.withColumn("status", F.when(F.col("_c"), "in_flight").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_c"), now).otherwise(F.col("updated_at"))).drop("_c").select(*queue.columns)


def superseded(queue: DataFrame) -> DataFrame:
    """Rows older than the newest done row of their path: an aggregate per path, joined back."""
    newest = queue.where("status = 'done'").groupBy("path").agg(F.max("enqueued_at").alias("newest"))
    return queue.join(newest, "path").where("enqueued_at < newest").drop("newest").select(*queue.columns)


def after_failure(queue: DataFrame, failed: DataFrame, now: Column, most: int = 10) -> DataFrame:
    """The queue after the rows of failed (path, sha256, error) failed once more: pending with a later time, or failed for good."""
    out = queue.join(failed, ["path", "sha256"], "left")
    hit, tried = F.col("error").isNotNull(), F.col("attempts") + 1
    wait = F.make_dt_interval(secs=backoff(tried).cast("decimal(18,6)"))
    return out.withColumns({
        "status": F.when(hit & (tried >= most), "failed").when(hit, "pending").otherwise(F.col("status")),
        "next_attempt_at": F.when(hit, now + wait).otherwise(F.col("next_attempt_at")),
        "attempts": F.when(hit, tried).otherwise(F.col("attempts")),
        "last_error": F.coalesce("error", "last_error"),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }).select(*queue.columns)


_KEYS = ["path", "sha256"]


def _fresh(items: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    values = {"status": F.lit("pending"), "attempts": F.lit(0), "next_attempt_at": now, "enqueued_at": now, "updated_at": now}
    return items.select(*_KEYS).distinct().select(*(F.col(f.name) if f.name in _KEYS else values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in queue.schema))


def enqueued(queue: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """The queue with items (path, sha256) that it hasn't yet; those that it has stay as they are."""
    return queue.unionByName(_fresh(items.join(queue.select(*_KEYS), _KEYS, "left_anti"), queue, now))


def requeued(queue: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """The queue with all items (path, sha256) pending anew, whatever state they were in; the time of the first entry stays."""
    hit = F.col("_hit").isNotNull()
    old = queue.join(items.select(*_KEYS).distinct().withColumn("_hit", F.lit(1)), _KEYS, "left")
    new = {"status": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None), "next_attempt_at": now, "updated_at": now}
    reset = old.select(*(F.when(hit, new[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in queue.schema))
    return enqueued(reset, items, now)


def after_success(queue: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """The queue after the rows of done (path, sha256) were sent: they are done, and waiting or failed rows of
    their paths that were entered strictly earlier go. Rows entered in the same moment stay."""
    hit = queue.join(done.select(*_KEYS).distinct(), _KEYS, "left_semi")
    newest = hit.groupBy("path").agg(F.max("enqueued_at").alias("_newest"))
    marked = queue.join(done.select(*_KEYS).distinct().withColumn("_hit", F.lit(1)), _KEYS, "left").join(newest, "path", "left")
    old = F.col("_hit").isNull() & F.col("status").isin("failed", "pending") & (F.col("enqueued_at") < F.col("_newest"))
    left = marked.where(~F.coalesce(old, F.lit(False)))
    done_now = F.col("_hit").isNotNull()
    return left.withColumn("status", F.when(done_now, "done").otherwise(F.col("status"))).withColumn("updated_at", F.when(done_now, now).otherwise(F.col("updated_at"))).select(*queue.columns)


def reset_failed(queue: DataFrame, now: Column) -> DataFrame:
    """The queue with failed rows pending anew."""
    failed = F.col("status") == "failed"
    at = lambda name, value: F.when(failed, value).otherwise(F.col(name))
    return queue.withColumns({"attempts": at("attempts", F.lit(0)), "next_attempt_at": at("next_attempt_at", now), "updated_at": at("updated_at", now), "status": at("status", F.lit("pending"))})


def released(queue: DataFrame, now: Column, lease: str = "1 hour") -> DataFrame:
    """The queue with rows that have been in flight for longer than the lease pending anew, as after a worker was lost."""
    late = (F.col("status") == "in_flight") & (F.col("updated_at") < now - F.expr(f"interval {lease}"))
    return queue.withColumns({"updated_at": F.when(late, now).otherwise(F.col("updated_at")), "status": F.when(late, "pending").otherwise(F.col("status"))})


def without_old_done(queue: DataFrame, now: Column, keep: str = "24 hours") -> DataFrame:
    """The queue without rows that were done longer ago than `keep`."""
    return queue.where(~F.coalesce((F.col("status") == "done") & (F.col("updated_at") < now - F.expr(f"interval {keep}")), F.lit(False)))


def hashes(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, mtime, size, sha256) of files (path, mtime, size, content): known ones (path, mtime, size, sha256) aren't hashed again."""
    keys = ["path", "mtime", "size"]
    new = files.join(known.select(*keys), keys, "left_anti").select(*keys, F.sha2("content", 256).alias("sha256"))
    return known.join(files.select(*keys), keys, "left_semi").select(*keys, "sha256").unionByName(new)
