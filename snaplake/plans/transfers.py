"""Files and queues on their way, transcripts rewritten, streams, and smaller filters and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.catalog import Snapshot
from snaplake.functions import text as T
from snaplake.operators import diff, filters, search, sync
from snaplake.operators.files import expect_files
from snaplake.plans.logs import _QUEUE, CLOSING, _queue, streamed, timed
from snaplake.sources import rewriting, transcripts
from snaplake.sources.uploads import payloads, unpacked
from snaplake.streaming import tail

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 400 AND source <> 'src1' AND contains(text, 'the')")
def mongo_filter_basic(spark, d):
    tree = {"lang": "en", "n_chars": {"$gt": 400}, "source": {"ne": "src1"}, "text": {"contains": "the"}}
    return _table(spark, d, "documents").where(filters.compile_filter(tree)).select("doc_id")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_len FROM t), h AS (SELECT doc_id, len(w) AS dl, unnest(list_filter(w, lambda x: x = 'hast' OR starts_with(x, 'fro'))) AS term FROM t),
  f AS (SELECT doc_id, dl, term, count(*) AS tf FROM h GROUP BY ALL), q AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
  SELECT doc_id AS id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))), 6) AS score FROM f JOIN q USING (term), s GROUP BY 1""")
def search_bm25_prefix(spark, d):
    """The last word of the query is the beginning of one."""
    return search.bm25(_table(spark, d, "documents"), "doc_id", "text", "hast fro", last_as_prefix=True).withColumn("score", F.round("score", 6))


@query("""SELECT doc_id, path FROM (SELECT doc_id, source || '/s-' || doc_id || '.jsonl' AS path FROM documents)
  WHERE NOT (path = 'src1/s-7.jsonl' OR regexp_matches(path, '^src2/.*[02468]\\.jsonl$') OR ends_with(replace(path, '.jsonl', ''), '-13') OR ends_with(replace(path, '.jsonl', ''), '55'))""".replace("\\\\", "\\"))
def blocklist_prune(spark, d):
    files = _table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/s-"), "doc_id", F.lit(".jsonl")).alias("path"))
    return files.where(~filters.blocked_path(F.col("path"), ["src1/s-7.jsonl"], ["src2/*[02468].jsonl"], ["-13", "55"]))


@query("""WITH c AS (SELECT page_id, url AS path, html || '.' AS content, CASE WHEN page_id % 2 = 0 THEN 'html' ELSE 'text' END AS file_type FROM pages)
  SELECT path, 'unexpected' AS problem, CAST(NULL AS VARCHAR) AS expected FROM c WHERE path NOT IN (SELECT url FROM pages WHERE page_id IN (1, 2, 3))
  UNION ALL SELECT path, 'file_type', 'html' FROM c WHERE path IN (SELECT url FROM pages WHERE page_id = 1) AND file_type <> 'html'
  UNION ALL SELECT path, 'content_contains', 'no such text' FROM c WHERE path IN (SELECT url FROM pages WHERE page_id = 2)
  UNION ALL SELECT path, 'size', '1' FROM c WHERE path IN (SELECT url FROM pages WHERE page_id = 3) AND length(content) <> 1 UNION ALL SELECT 'gone', 'missing', NULL""")
def fs_diff_expect(spark, d):
    """Changed pages against four specs, one of them for a path that isn't there."""
    pages = _table(spark, d, "pages")
    url = {r.page_id: r.url for r in pages.where(F.col("page_id").isin(1, 2, 3)).select("page_id", "url").collect()}  # three keys
    changed = pages.select(F.col("url").alias("path"), F.concat("html", F.lit(".")).alias("content"), F.when(F.col("page_id") % 2 == 0, "html").otherwise("text").alias("file_type"))
    specs = [{"path": url[1], "file_type": "html"}, {"path": url[2], "content_contains": "no such text"}, {"path": url[3], "size": 1}, {"path": "gone"}]
    return expect_files(changed.withColumn("size", F.char_length("content").cast("long")), specs)


@query(f"WITH {_QUEUE}, m AS (SELECT path, max(enqueued_at) AS newest FROM q WHERE status = 'in_flight' GROUP BY 1) SELECT path, sha256, CASE WHEN status = 'in_flight' THEN 'done' ELSE status END AS status FROM q LEFT JOIN m USING (path) WHERE NOT coalesce(status = 'pending' AND enqueued_at < newest, false)")
def queue_mark_done_prune(spark, d):
    q = _queue(spark, d)
    return sync.after_success(q, q.where("status = 'in_flight'").select("path", "sha256"), F.lit("2024-02-20").cast("timestamp")).select("path", "sha256", "status")


@query(f"WITH {_QUEUE}, n AS (SELECT path, sha256 FROM q WHERE status = 'done' UNION SELECT 'new' || doc_id, md5(doc_id::VARCHAR) FROM documents) SELECT path, sha256, CASE WHEN status = 'done' OR status IS NULL THEN 'pending' ELSE status END AS status FROM q FULL JOIN n USING (path, sha256)")
def queue_requeue(spark, d):
    q = _queue(spark, d)
    new = _table(spark, d, "documents").select(F.concat(F.lit("new"), "doc_id").alias("path"), F.md5(F.col("doc_id").cast("string")).alias("sha256"))
    return sync.requeued(q, q.where("status = 'done'").select("path", "sha256").unionByName(new), F.lit("2024-02-20").cast("timestamp")).select("path", "sha256", "status")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS raw_bytes, true AS no_larger, md5(text) AS digest FROM documents")
def upload_payloads(spark, d):
    """The documents as they are sent: packed where that is smaller, and what they are once unpacked again. Nothing in them is scrubbed."""
    files = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    sent = payloads(files)
    sizes = sent.select("path", "raw_bytes", (F.col("stored_bytes") <= F.col("raw_bytes")).alias("no_larger"))
    return sizes.join(unpacked(sent).select("path", F.md5("content").alias("digest")), "path")


def _lines(spark, d):
    """The conversations as block-style lines, a file each."""
    talk = _table(spark, d, "conversations")
    block = F.array(F.struct(F.lit("text").alias("type"), "text"))
    row = F.struct(F.col("role").alias("type"), F.concat("conv_id", F.lit("/"), "turn").alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), F.struct("role", block.alias("content")).alias("message"))
    return talk.select(F.col("conv_id").cast("string").alias("file"), (F.col("turn") + 1).cast("int").alias("line_no"), F.to_json(row).alias("line"))


@query("SELECT conv_id::VARCHAR AS file, CAST(turn + 1 AS INTEGER) AS line_no, true AS same FROM conversations")
def serialize_roundtrip(spark, d):
    lines = _lines(spark, d)
    back = rewriting.rows_as_read(transcripts.block_events(lines)).withColumnRenamed("line", "written")
    return lines.join(back, ["file", "line_no"]).select("file", "line_no", (F.col("line") == F.col("written")).alias("same"))


@query("""SELECT conv_id::VARCHAR AS file, CAST(turn + 1 AS BIGINT) AS line_no, CASE WHEN role IN ('user', 'assistant') THEN 'response_item' ELSE 'event_msg' END AS layer, CASE WHEN role IN ('user', 'assistant') THEN text END AS text FROM conversations
  UNION ALL SELECT DISTINCT conv_id::VARCHAR, 0, 'session_meta', NULL FROM conversations""")
def convert_transcripts(spark, d):
    out = rewriting.converted(_lines(spark, d), "rows", "blocks")
    return out.select("file", F.col("line_no").cast("bigint").alias("line_no"), F.get_json_object("line", "$.type").alias("layer"), F.get_json_object("line", "$.payload.content[0].text").alias("text"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type LIKE '%click%' OR event_type LIKE '%view%' GROUP BY 1")
def stream_tail_counts(spark, d):
    """The stream, filtered by parts of a text; what it let through is counted."""
    return streamed(spark, d, lambda events: tail.url_filter(events, "event_type", ["click", "view"])).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  g AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM e)
  SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY user_id, part""")
def stream_debounce(spark, d):
    """Runs of a user's events with less than two hours between them, appended as the watermark passes their end."""
    return streamed(spark, d, lambda events: tail.debounced(timed(events), "user_id", "ts", "2 hours").withColumns({c: tail.zoneless(c) for c in ("first", "last")}), CLOSING)


@query("""SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) - to_hours(6 * k) AS start, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY 1, 2""")
def stream_sliding_windows(spark, d):
    """Windows of twelve hours, one every six."""
    return streamed(spark, d, lambda events: tail.windowed(timed(events), "ts", "12 hours", ["event_type"], slide="6 hours").withColumn("start", tail.zoneless("start")), CLOSING)


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM conversations) SELECT conv_id, turn, CASE WHEN length(flat) > 60 THEN substr(flat, 1, 59) || '…' ELSE flat END AS title FROM t""")
def session_titles(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", T.short_title(F.col("text")).alias("title"))


@query("""WITH s AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) AS s FROM events)
  SELECT event_id, CASE WHEN s < 0 THEN 'future' WHEN s < 60 THEN CAST(s AS INT) || 's ago' WHEN s < 3600 THEN CAST(floor(s / 60) AS INT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS INT) || 'h ago' WHEN s < 2592000 THEN CAST(floor(s / 86400) AS INT) || 'd ago' ELSE left(stamp, 10) END AS age FROM s""")
def relative_age(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _table(spark, d, "events").select("event_id", T.age(stamp, F.lit("2024-01-20").cast("timestamp")).alias("age"))


@query("""SELECT table_name, change_type, count(*) AS n FROM (SELECT 'customer' AS table_name, 'modify' AS change_type FROM customer WHERE c_custkey % 5 = 1 UNION ALL SELECT 'part', 'delete' FROM part WHERE p_partkey % 4 = 3 UNION ALL SELECT 'part', 'insert' FROM part WHERE p_partkey % 6 = 0) GROUP BY ALL""")
def diff_two_tables(spark, d):
    """Totals over the changes of all tables of two snapshots; what didn't change has none."""
    before = Snapshot.load(spark, d, ["customer", "part", "nation", "lineitem"])
    customer, part = before.frame("customer"), before.frame("part")
    after = before.replace(
        customer=customer.withColumn("c_name", F.expr("case when c_custkey % 5 = 1 then concat(c_name, '!') else c_name end")),
        part=part.where("p_partkey % 4 <> 3").unionByName(part.where("p_partkey % 6 = 0").withColumn("p_partkey", F.expr("-p_partkey - 1"))),
    )
    return diff.snapshot_changes(before, after).groupBy("table_name", "change_type").agg(F.count("*").alias("n"))
