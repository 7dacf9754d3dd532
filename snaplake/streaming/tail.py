"""Streams: tailing JSON lines, quiet periods, windows with late data, delivery that may repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tail(spark: SparkSession, path: str, schema: str, form: str = "json", files: int = 100) -> DataFrame:
    """A stream of the rows of a folder's files, new ones as they come; at most `files` new files in a batch."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).load(path)


def event_time(name: str) -> Column:
    """A time without a zone as the instant that it is in UTC, whatever the session's zone: watermarks need instants."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)"))


def zoneless(name: str) -> Column:
    """The other way."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros(`{name}`), TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def url_filter(stream: DataFrame, url: str, patterns: list[str]) -> DataFrame:
    """Rows whose url contains one of the patterns, with counts of rows read and kept as observed metrics."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains(F.col(url), F.lit(p))
    hit = F.coalesce(hit, F.lit(False))
    return stream.observe("tail", F.count("*").alias("rows_read"), F.count_if(hit).alias("rows_kept")).where(hit)


def debounced(stream: DataFrame, key: str, time: str, quiet: str = "2 seconds 500 milliseconds", late: str = "1 minute") -> DataFrame:
    """(key, first, last, n): a row when a key has been quiet for so long."""
    window = F.session_window(time, quiet)
    out = stream.withWatermark(time, late).groupBy(window, key).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))
    return out.select(key, "first", "last", "n")


def windowed(stream: DataFrame, time: str, length: str, keys: list[str], slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows, sliding ones if slide is given. An extension of ours."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    out = stream.withWatermark(time, late).groupBy(window, *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def deliver(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, attempts: int = 3, mode: str = "append"):
    """Each batch is given to send (with its number, so that it can tell a repeat) until it doesn't fail, `attempts` times at most; started once over what is there."""

    def batch(rows: DataFrame, number: int) -> None:
        for k in range(attempts):
            try:
                return send(rows, number)
            except Exception:
                if k + 1 == attempts:
                    raise

    return stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconciled(local: DataFrame, remote: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "600 seconds"):
    """Each batch of local files (path, sha256) is held against the remote manifest as it is then, and what differs is published; every: the interval, None: once over what is there."""
    from snaplake.operators.sync import manifest_diff

    def batch(rows: DataFrame, number: int) -> None:
        newest = rows.groupBy("path").agg(F.max("sha256").alias("sha256"))
        publish(manifest_diff(newest, remote()), number)

    writer = local.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def progress(stream: DataFrame, status: str, terminal: list[str]) -> DataFrame:
    """(status, n, done) so far, for a stream written in mode complete; done: whether the status is an end."""
    return stream.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n")).withColumn("done", F.col("status").isin(terminal))


def write_traffic(stream: DataFrame, folder: str, checkpoint: str, most: int = 10_000):
    """Logs traffic rows (with maps request_headers and response_headers, texts request_body and response_body, if they are there) as JSON lines: sensitive headers hidden, bodies cut with their length beside them; started once over what is there."""
    from snaplake.functions.text import redacted_headers

    out = stream
    for c in ("request_headers", "response_headers"):
        if c in stream.columns:
            out = out.withColumn(c, redacted_headers(F.col(c)))
    for c in ("request_body", "response_body"):
        if c in stream.columns:
            out = out.withColumn(f"{c}_length", F.char_length(c)).withColumn(c, F.substring(c, 1, most))
    return out.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
