"""Sessions, replays, budgets, queues and streams over events and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from snaplake.catalog import shared_folder
from snaplake.operators import sessions as S
from snaplake.operators import rollups, sync
from snaplake.streaming import stateful, tail

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _talk(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def session_index_latest(spark, d):
    return S.latest(_events(spark, d).select("user_id", "event_id", "event_type", "value"), "user_id", ["event_id"])


def _sessions(spark, d):
    return _events(spark, d).groupBy(F.lpad(F.col("user_id").cast("string"), 8, "0").alias("id")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_active"), F.count("*").alias("event_count"))


_SESSIONS = "s AS (SELECT lpad(user_id::VARCHAR, 8, '0') AS id, strftime(max(ts), '%Y-%m-%d') AS last_active, count(*) AS event_count FROM events GROUP BY 1)"


@query(f"WITH {_SESSIONS} SELECT id, last_active, event_count FROM s ORDER BY last_active DESC, id DESC LIMIT 21")
def session_page_first(spark, d):
    return S.page(_sessions(spark, d), 20)


@query(f"WITH {_SESSIONS} SELECT id, last_active, event_count FROM s WHERE (last_active, id) < ('2024-01-29', '00000050') ORDER BY last_active DESC, id DESC LIMIT 21")
def session_page_next(spark, d):
    return S.page(_sessions(spark, d), 20, S.cursor_of("2024-01-29", "00000050"))


@query("SELECT doc_id FROM documents WHERE contains(lower(doc_id::VARCHAR || ' ' || lang || ' ' || source), '1 en src')")
def session_query_substring(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").where(S.matches_query("1 EN src", ["doc_id", "lang", "source"])).select("doc_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS store FROM events WHERE event_id % 3 = 0 OR event_id % 2 = 0")
def chained_dedupe(spark, d):
    e = _events(spark, d).select("event_id")
    return S.first_store_wins([e.where("event_id % 3 = 0").withColumn("store", F.lit("a")), e.where("event_id % 2 = 0").withColumn("store", F.lit("b"))], "event_id")


@query("""WITH p AS (SELECT event_id AS id, value FROM events WHERE event_id % 3 = 0 ORDER BY value DESC, id DESC LIMIT 40), e AS (SELECT min((value, id)) AS low, max((value, id)) AS high FROM p)
  SELECT id, value FROM p UNION SELECT event_id, value FROM events, e WHERE event_id % 2 = 0 AND (value, event_id) BETWEEN low AND high""")
def page_overlay_window(spark, d):
    e = _events(spark, d).select(F.col("event_id").alias("id"), "value")
    return S.overlay(e.where("id % 3 = 0").orderBy(F.desc("value"), F.desc("id")).limit(40), e.where("id % 2 = 0"), "id", "value").select("id", "value")


@query("""WITH RECURSIVE s AS (SELECT DISTINCT conv_id AS id, CASE WHEN conv_id % 4 <> 0 THEN conv_id - 1 END AS parent, 2 AS cap FROM conversations),
  walk AS (SELECT id, id AS ancestor, 0 AS depth, CAST(NULL AS BIGINT) AS cap FROM s UNION ALL SELECT w.id, f.parent, w.depth + 1, f.cap FROM walk w JOIN s f ON f.id = w.ancestor JOIN s p ON p.id = f.parent),
  n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)
  SELECT id, ancestor, turn, row_number() OVER (PARTITION BY id ORDER BY depth DESC, nth) AS place FROM walk JOIN n ON n.conv_id = ancestor WHERE cap IS NULL OR nth <= cap""")
def fork_chain_replay(spark, d):
    talk = _talk(spark, d).select("conv_id", "turn")
    sessions = talk.select("conv_id").distinct().select(F.col("conv_id").alias("id"), F.expr("case when conv_id % 4 <> 0 then conv_id - 1 end").alias("forked_from"), F.lit(2).alias("fork_point"))
    return S.replay(S.ancestors(sessions), talk, "conv_id", "turn").select("id", "ancestor", "turn", F.col("place").cast("bigint").alias("place"))


@query("""WITH c AS (SELECT conv_id, turn, greatest(1, length(text) // 4) + 90 AS cost FROM conversations), r AS (SELECT conv_id, turn, cost, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running FROM c)
  SELECT conv_id, turn, CAST(cost AS BIGINT) AS cost, CAST(running AS BIGINT) AS running FROM r WHERE running <= 700""")
def compact_suffix_budget(spark, d):
    return S.suffix_within(_talk(spark, d), "conv_id", "turn", S.token_estimate(F.col("text")) + 90, 700).select("conv_id", "turn", "cost", "running")


@query("SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS asked, arg_min(text, turn) FILTER (role = 'user') AS first_text, arg_max(text, turn) FILTER (role = 'user') AS last_text FROM conversations GROUP BY 1")
def compact_summary(spark, d):
    return S.exchange_summary(_talk(spark, d), "conv_id", "turn", F.col("role") == "user")


@query("SELECT q.conv_id, q.turn, length(q.text) AS asked, length(a.text) AS answered FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def tool_call_result_join(spark, d):
    t = _talk(spark, d)
    calls = t.where("role = 'user'").select("conv_id", "turn", F.char_length("text").cast("bigint").alias("asked"))
    results = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.char_length("text").cast("bigint").alias("answered"))
    return S.answered(calls, results, ["conv_id", "turn"])


@query("""WITH c AS (SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS paid FROM events)
  SELECT user_id, event_id, paid, coalesce(lag(paid) OVER (PARTITION BY user_id ORDER BY event_id) <> paid, false) AS paid_changed FROM c""")
def carry_forward_state(spark, d):
    return S.carried_forward(_events(spark, d), "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")), "paid").select("user_id", "event_id", "paid", "paid_changed")


@query("SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'click') AS first_click FROM events GROUP BY 1")
def first_non_null_context(spark, d):
    return S.first_known(_events(spark, d), "user_id", "event_id", {"first_click": F.when(F.col("event_type") == "click", F.col("value"))})


def _queue(spark, d):
    return _events(spark, d).select(F.format_string("p%d", F.expr("user_id")).alias("path"), F.md5(F.col("event_id").cast("string")).alias("sha256"), F.expr("case event_id % 4 when 0 then 'done' when 1 then 'in_flight' else 'pending' end").alias("status"), F.expr("cast(event_id % 12 as int)").alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.expr("ts + interval 5 days").alias("next_attempt_at"), F.col("ts").alias("enqueued_at"), F.col("ts").alias("updated_at"))


_QUEUE = "q AS (SELECT 'p' || user_id AS path, md5(event_id::VARCHAR) AS sha256, CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'in_flight' ELSE 'pending' END AS status, ts + INTERVAL 5 DAYS AS next_attempt_at, ts AS enqueued_at, event_id % 12 AS attempts FROM events)"


@query(f"WITH {_QUEUE} SELECT status, count(*) AS n FROM q GROUP BY 1")
def queue_stats(spark, d):
    return rollups.queue_stats(_queue(spark, d))


@query(f"WITH {_QUEUE} SELECT path, sha256 FROM q WHERE status = 'pending' AND next_attempt_at <= TIMESTAMP '2024-01-20' ORDER BY enqueued_at, path, sha256 LIMIT 32")
def queue_claim(spark, d):
    return sync.claim(_queue(spark, d), F.lit("2024-01-20").cast("timestamp"), 32)


@query(f"WITH {_QUEUE} SELECT path, sha256, status FROM q WHERE enqueued_at < (SELECT max(enqueued_at) FROM q n WHERE n.path = q.path AND n.status = 'done')")
def queue_superseded(spark, d):
    return sync.superseded(_queue(spark, d)).select("path", "sha256", "status")


@query(f"WITH {_QUEUE} SELECT path, sha256, CASE WHEN attempts + 1 >= 10 THEN 'failed' ELSE 'pending' END AS status, attempts + 1 AS attempts FROM q WHERE status = 'in_flight'")
def queue_failures(spark, d):
    q = _queue(spark, d)
    failed = q.where("status = 'in_flight'").select("path", "sha256", F.lit("e").alias("error"))
    return sync.after_failure(q, failed, F.lit("2024-01-20").cast("timestamp")).where("last_error = 'e'").select("path", "sha256", "status", F.col("attempts").cast("bigint").alias("attempts"))


@query(f"WITH {_QUEUE} SELECT path, sha256, attempts, least(0.5 * pow(2.0, attempts), 1800.0)::DOUBLE AS seconds FROM q")
def backoff_table(spark, d):
    """How long each row of the queue waits after its next failure."""
    return _queue(spark, d).select("path", "sha256", F.col("attempts").cast("bigint").alias("attempts"), sync.backoff(F.col("attempts")).alias("seconds"))


@query("SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_windows(spark, d):
    """As a stream over the table's file, started once over what is there; the counts are read back from the shared folder."""
    return streamed(spark, d, lambda events: tail.windowed(timed(events), "ts", "6 hours", ["event_type"]).withColumn("start", tail.zoneless("start")), CLOSING)


def timed(events):
    return events.withColumn("ts", tail.event_time("ts"))


#: A row long after all others: it moves the watermark past their windows, so that these close and are told; its own stays open.
CLOSING = {"event_id": -1, "ts": "2100-01-01", "user_id": -1, "event_type": "", "value": 0}


def streamed(spark, d, change, closing: dict | None = None):
    """What a stream over the table events appends after `change`, started once over what is there; read back from the shared folder, a file set for each batch. closing: one more row of the stream."""
    base, schema = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", _events(spark, d).schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet" if _is_folder(spark, f"{d}/events.parquet") else f"{d}/events.parque[t]")
    if closing:
        spark.range(1).select(*(F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in schema)).write.parquet(f"{base}/closing")
        stream = stream.unionByName(spark.readStream.schema(schema).parquet(f"{base}/closing"))
    out = change(stream)
    tail.deliver(out, lambda rows, n: rows.write.mode("overwrite").parquet(f"{base}/out/batch={n}"), f"{base}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").select(*out.columns)


def _is_folder(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


@query(f"""WITH {_QUEUE}, q2 AS (SELECT path, sha256, enqueued_at, attempts % 4 AS k FROM q), d AS (SELECT path, max(enqueued_at) AS newest FROM q2 WHERE k = 0 GROUP BY 1)
  SELECT path, sha256, CASE k WHEN 0 THEN 'done' WHEN 3 THEN 'in_flight' ELSE 'pending' END AS status, CASE WHEN k IN (1, 2) THEN k ELSE 0 END AS attempts
  FROM q2 LEFT JOIN d USING (path) WHERE k IN (0, 3) OR coalesce(enqueued_at >= newest, true)""")
def stream_queue_machine(spark, d):
    """A queue as keyed state, from a stream of commands: every event is entered, a quarter each is sent, fails once, fails twice, and is claimed. A sent one prunes older ones of its path."""
    stamp = lambda days: F.expr(f"ts + interval {days} days")

    def commands(events):
        k = F.col("event_id") % 12 % 4
        sent = F.when(k == 0, F.array(F.struct(F.lit("claim").alias("command"), stamp(100).alias("at")), F.struct(F.lit("done").alias("command"), stamp(200).alias("at"))))
        failed = F.when(k == 1, F.array(F.struct(F.lit("failed").alias("command"), stamp(100).alias("at")))).when(k == 2, F.array(F.struct(F.lit("failed").alias("command"), stamp(100).alias("at")), F.struct(F.lit("failed").alias("command"), stamp(101).alias("at"))))
        claimed = F.when(k == 3, F.array(F.struct(F.lit("claim").alias("command"), stamp(50).alias("at"))))
        all_of = F.concat(F.array(F.struct(F.lit("enqueue").alias("command"), F.col("ts").alias("at"))), F.coalesce(sent, failed, claimed))
        rows = events.select(F.format_string("p%d", "user_id").alias("path"), F.md5(F.col("event_id").cast("string")).alias("sha256"), F.posexplode(all_of).alias("nth", "c"))
        return rows.select("path", "sha256", F.lit("e").alias("error"), "nth", "c.*").withColumn("at", tail.event_time("at"))

    steps = streamed(spark, d, lambda events: stateful.work_queue(commands(events), by_event_time=True, lease_s=10**10, kept_s=10**10))
    return stateful.queue_now(steps).select("path", "sha256", "status", F.col("attempts").cast("bigint").alias("attempts"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM e)
  SELECT user_id::VARCHAR AS user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY user_id, part""")
def stream_quiet_timers(spark, d):
    """Runs of a user's events with less than two hours between them, by keyed state and timers, appended as they close."""
    out = streamed(spark, d, lambda events: stateful.quiet_keys(timed(events), "user_id", 7200, "ts"), CLOSING)
    return out.select(F.col("key").alias("user_id"), "first", "last", "n")
