"""Filters, aggregates and search over documents and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from snaplake.functions import text as T
from snaplake.operators import aggregate as agg
from snaplake.operators import filters, rollups, search

QUERIES, SQL = {}, {}
NOW = datetime(2024, 1, 20)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 500 AND NOT (source = 'src0') AND (n_chars < 2000 OR source = 'src3')")
def mongo_filter_boolean(spark, d):
    tree = {"lang": {"$in": ["en", "de"]}, "n_chars": {"gte": 500}, "$not": {"source": "src0"}, "$or": [{"n_chars": {"$lt": 2000}}, {"source": {"eq": "src3"}}]}
    return _docs(spark, d).where(filters.compile_filter(tree)).select("doc_id", "lang")


@query(r"""WITH t AS (SELECT doc_id, text, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS w FROM documents)
  SELECT doc_id, w LIKE '% the %' AND w LIKE '% that %' AS all_tokens, w LIKE '% und %' OR w LIKE '% avec %' AS any_token, contains(w, ' of the ') AS phrase, contains(w, ' in th') AS prefix, regexp_matches(text, '^The') AS glob, regexp_matches(text, 'th[ei]s') AS regex FROM t""")
def mongo_filter_text(spark, d):
    m = lambda op, q: filters.text_match(F.col("text"), op, q).alias(op)
    return _docs(spark, d).select("doc_id", m("all_tokens", "the that"), m("any_token", "und avec"), m("phrase", "of the"), m("prefix", "in th"), m("glob", "The*"), m("regex", "th[ei]s"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-18 12:00:00'")
def time_filter_since(spark, d):
    return _events(spark, d).where(filters.time_filter({"field": "ts", "since": "7d", "lt": datetime(2024, 1, 18, 12)}, NOW)).select("event_id")


@query("SELECT event_type, user_id % 10 AS shard, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, min(value) AS low, max(value) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def agg_group_metrics(spark, d):
    rows = _events(spark, d).withColumn("shard", F.expr("user_id % 10")).withColumn("exact", F.col("value").cast("decimal(18,2)"))
    out = agg.aggregate(rows, {"group_by": ["event_type", "shard"], "metrics": {"n": "count", "total": {"sum": "exact"}, "low": {"min": "value"}, "high": {"max": "value"}, "users": {"distinct": "user_id"}}})
    return out.withColumn("total", F.col("total").cast("double"))


def _bucket(interval):
    def run(spark, d):
        return agg.aggregate(_events(spark, d), {"group_by": ["event_type"], "time_bucket": {"field": "ts", "interval": interval}, "metrics": {"n": "count", "users": {"distinct": "user_id"}}})

    QUERIES[f"agg_time_bucket_{interval}"] = run
    SQL[f"agg_time_bucket_{interval}"] = f"SELECT event_type, CAST(date_trunc('{interval}', ts) AS TIMESTAMP) AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2"


for _interval in ("hour", "day", "week", "month"):
    _bucket(_interval)


@query("SELECT user_id, count(*) AS n, max(value) AS top FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(*) >= 3 AND max(value) > 10 ORDER BY n DESC, user_id LIMIT 20")
def agg_having_order_limit(spark, d):
    return agg.aggregate(_events(spark, d), {"filters": {"event_type": {"ne": "error"}}, "group_by": ["user_id"], "metrics": {"n": "count", "top": {"max": "value"}}, "having": {"n": {"gte": 3}, "top": {"gt": 10}}, "order_by": [("n", "desc")], "limit": 20})


@query("SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality = 1) / count(*) AS pass_rate, avg(CASE WHEN toxic = 1 THEN NULL ELSE quality END) AS average_score FROM documents JOIN labels USING (doc_id) GROUP BY source")
def task_rollup(spark, d):
    rows = _docs(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rows = rows.select("source", (F.col("quality") == 1).alias("ok"), F.when(F.col("toxic") != 1, F.col("quality")).alias("score"))
    return agg.pass_rates(rows, "source", "ok", "score")


@query("WITH e AS (SELECT json_extract_string(props, '$.k') AS category, event_type AS example FROM events) SELECT category, count(*) AS n, array_to_string(list_sort(list(DISTINCT example))[1:3], ',') AS examples FROM e GROUP BY 1")
def error_breakdown(spark, d):
    rows = _events(spark, d).select(F.get_json_object("props", "$.k").alias("category"), F.col("event_type").alias("example"))
    return agg.error_breakdown(rows, "category", "example", most=3).withColumn("examples", F.array_join("examples", ","))


@query("SELECT event_type AS run_id, count(*) AS total, count(*) FILTER (value > 10) AS running, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def runs_rollup(spark, d):
    return rollups.run_rollup(_events(spark, d), "event_type", F.col("value") > 10, "ts")


@query("SELECT doc_id, CASE WHEN quality > 0 THEN round(toxic / quality, 4) ELSE CAST(toxic AS DOUBLE) END AS score FROM labels")
def rubric_normalise(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", agg.normalised_score(F.col("toxic").cast("double"), F.col("quality")).alias("score"))


@query("SELECT source, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, max(doc_id) AS newest FROM documents GROUP BY 1")
def source_summary(spark, d):
    return rollups.source_summary(_docs(spark, d), "source", F.octet_length("text"), "doc_id")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_len FROM t), h AS (SELECT doc_id, len(w) AS dl, unnest(list_filter(w, lambda x: x IN ('hast', 'was', 'from'))) AS term FROM t),
  f AS (SELECT doc_id, dl, term, count(*) AS tf FROM h GROUP BY ALL), q AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
  SELECT doc_id AS id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))), 6) AS score FROM f JOIN q USING (term), s GROUP BY 1""")
def search_bm25(spark, d):
    return search.bm25(_docs(spark, d), "doc_id", "text", "hast was from").withColumn("score", F.round("score", 6))


_QUERY = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_QSQL = "[" + ", ".join(map(str, _QUERY)) + "]::DOUBLE[]"


@query(f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {_QSQL}), 6) AS score FROM embeddings")
def search_semantic(spark, d):
    return search.semantic(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", _QUERY).withColumn("score", F.round("score", 6))


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_len FROM t), h AS (SELECT doc_id, len(w) AS dl, unnest(list_filter(w, lambda x: x IN ('hast', 'was', 'from'))) AS term FROM t),
  f AS (SELECT doc_id, dl, term, count(*) AS tf FROM h GROUP BY ALL), q AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
  b AS (SELECT doc_id AS id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))) AS score FROM f JOIN q USING (term), s GROUP BY 1),
  r AS (SELECT id, row_number() OVER (ORDER BY round(score, 12) DESC, id) AS r FROM b UNION ALL SELECT vec_id, row_number() OVER (ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QSQL}) DESC, vec_id) FROM embeddings)
  SELECT id, sum(1 / (60 + r)) AS score FROM r GROUP BY 1 ORDER BY score DESC, id LIMIT 50""")
def search_hybrid(spark, d):
    return search.hybrid(search.bm25(_docs(spark, d), "doc_id", "text", "hast was from"), search.semantic(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", _QUERY), 50)


@query("SELECT user_id AS id, max(ts) AS last_active FROM events GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 30")
def search_recent(spark, d):
    return search.recent(_events(spark, d), "user_id", "ts", 30).select("id", F.timestamp_seconds("score").alias("last_active"))


@query(r"""SELECT doc_id, regexp_replace(lower(text), '[!-/:-@\[-`{-~\s]+', '', 'g') AS plain FROM documents""")
def normalise_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalised(F.col("text")).alias("plain"))


@query(r"SELECT p_partkey, len(regexp_extract_all(replace(p_name || ' 1,234.5 -7', ',', ''), '-?\d+\.?\d*')) AS n, list_sum(list_transform(regexp_extract_all(replace(p_name || ' 1,234.5 -7', ',', ''), '-?\d+\.?\d*'), lambda x: CAST(x AS DOUBLE))) AS total FROM part")
def extract_numbers(spark, d):
    n = T.numbers(F.concat("p_name", F.lit(" 1,234.5 -7")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.size(n).cast("bigint").alias("n"), F.aggregate(n, F.lit(0.0), lambda s, x: s + x).alias("total"))


_SPLICED = "text || CASE doc_id % 4 WHEN 0 THEN ' AKIA' || upper(left(md5(doc_id::VARCHAR), 16)) WHEN 1 THEN ' Bearer ' || md5(doc_id::VARCHAR) WHEN 2 THEN ' /home/u' || doc_id || '/x postgres://u:p@h/db' ELSE '' END"


@query(f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_SPLICED}, 'AKIA[0-9A-Z]{{16}}', '[REDACTED_AWS_KEY]', 'g'), '(?i)(postgres|mysql|mongodb(\\+srv)?|redis|amqp)://[^\\s''"]+', '[REDACTED_CONNECTION_STRING]', 'g'), '(?i)bearer\\s+[A-Za-z0-9_\\-\\.]{{20,}}', 'Bearer [REDACTED_TOKEN]', 'g'), '/home/[a-zA-Z0-9._-]+', '/home/[user]', 'g')) AS digest FROM documents""")
def scrub_text(spark, d):
    key = F.md5(F.col("doc_id").cast("string"))
    extra = F.when(F.expr("doc_id % 4 = 0"), F.concat(F.lit(" AKIA"), F.upper(F.substring(key, 1, 16)))).when(F.expr("doc_id % 4 = 1"), F.concat(F.lit(" Bearer "), key)).when(F.expr("doc_id % 4 = 2"), F.concat(F.lit(" /home/u"), "doc_id", F.lit("/x postgres://u:p@h/db"))).otherwise(F.lit(""))
    return _docs(spark, d).select("doc_id", F.md5(T.scrub(F.concat("text", extra)).cast("binary")).alias("digest"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/@]*@)?', '')), '/+$', ''), '\\.git$', '') AS repo FROM pages")
def repo_url_normalise(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.repository(F.col("url")).alias("repo"))


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(url, '://([^/]+)', 1)), '(^|\\.)example\\.org$')")
def host_whitelist(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").where(filters.host_allowed(F.col("url"), ["example.org"])).select("page_id")
