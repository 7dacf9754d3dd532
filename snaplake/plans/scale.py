"""Work over one huge session, tables that differ in few rows, manifests of many files, each without a task or a shuffle that holds it all."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from snaplake.catalog import shared_folder
from snaplake.operators import manifest, pageindex, reconcile, textindex, vectorindex
from snaplake.operators import sessions as S
from snaplake.plans.extras import _table

QUERIES, SQL = {}, {}

#: Parts that sessions are cut into.
PARTS = 16


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _skewed(spark, d):
    """The events with one session that has nine tenths of them."""
    return _table(spark, d, "events").select(F.expr("case when event_id % 10 < 9 then 0 else user_id end").alias("session"), "event_id", "event_type", "value")


_SKEWED = "e AS (SELECT CASE WHEN event_id % 10 < 9 THEN 0 ELSE user_id END AS session, event_id, event_type, value FROM events)"


@query(f"WITH {_SKEWED}, r AS (SELECT session, event_id, 1 + event_id % 7 AS cost, sum(1 + event_id % 7) OVER (PARTITION BY session ORDER BY event_id DESC) AS running FROM e) SELECT session, event_id, cost, CAST(running AS BIGINT) AS running FROM r WHERE running <= 5000")
def huge_session_suffix(spark, d):
    return S.suffix_within(_skewed(spark, d), "session", "event_id", 1 + F.col("event_id") % 7, 5000, parts=PARTS).select("session", "event_id", "cost", "running")


@query(f"""WITH {_SKEWED}, c AS (SELECT session, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY session ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS paid FROM e)
  SELECT session, event_id, paid, coalesce(lag(paid) OVER (PARTITION BY session ORDER BY event_id) <> paid, false) AS paid_changed FROM c""")
def huge_session_carried(spark, d):
    return S.carried_forward(_skewed(spark, d), "session", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")), "paid", parts=PARTS).select("session", "event_id", "paid", "paid_changed")


@query(f"WITH {_SKEWED}, c AS (SELECT session, event_id, event_type, lag(event_type) OVER (PARTITION BY session ORDER BY event_id) AS previous FROM e) SELECT session, event_id, previous, event_type FROM c WHERE previous <> event_type")
def huge_session_changes(spark, d):
    return S.changes_of(_skewed(spark, d), "session", "event_id", "event_type", parts=PARTS).select("session", "event_id", "previous", "event_type")


@query("""SELECT o_orderkey::VARCHAR AS row_id, 'modify' AS change_type, 'o_totalprice' AS field FROM orders WHERE o_orderkey % 1000 = 7
  UNION ALL SELECT o_orderkey::VARCHAR, 'delete', NULL FROM orders WHERE o_orderkey % 2000 = 11 UNION ALL SELECT (-o_orderkey - 1)::VARCHAR, 'insert', NULL FROM orders WHERE o_orderkey % 3000 = 13""")
def diff_reconciled(spark, d):
    """Orders against themselves after a few changes; only ranges of keys that differ are compared row by row."""
    before = _table(spark, d, "orders")
    after = before.where("o_orderkey % 2000 <> 11").withColumn("o_totalprice", F.expr("case when o_orderkey % 1000 = 7 then o_totalprice + 1 else o_totalprice end"))
    after = after.unionByName(before.where("o_orderkey % 3000 = 13").withColumn("o_orderkey", F.expr("-o_orderkey - 1")))
    return reconcile.reconciled_changes(before, after, ["o_orderkey"], "orders").select("row_id", "change_type", "field")


def _files(spark, d):
    return _table(spark, d, "events").select(F.concat(F.lit("u"), "user_id", F.lit("/"), "event_id").alias("path"), F.sha2(F.concat_ws("/", "event_type", "value"), 256).alias("sha256"))


@query("""WITH f AS (SELECT event_id, 'u' || user_id || '/' || event_id AS path FROM events)
  SELECT path, CASE WHEN event_id % 500 = 3 THEN 'changed' WHEN event_id % 900 = 5 THEN 'new' ELSE 'removed' END AS status FROM f WHERE event_id % 500 = 3 OR event_id % 900 = 5
  UNION ALL SELECT 'gone/' || doc_id, 'removed' FROM documents WHERE doc_id % 100 = 1""")
def manifest_tree_diff(spark, d):
    """Two stored trees of files, the other one updated after it was written; the difference is found by descending."""
    here, there = (f"{shared_folder(spark)}/{x}-{uuid.uuid4().hex}" for x in ("here", "there"))
    files = _files(spark, d)
    manifest.build(files, here)
    number = F.substring_index("path", "/", -1).cast("long")
    manifest.build(files.where(number % 900 != 5), there)
    other = files.where((number % 500 == 3) & (number % 900 != 5)).withColumn("sha256", F.sha2("path", 256))
    manifest.apply(spark, there, other.unionByName(_table(spark, d, "documents").where("doc_id % 100 = 1").select(F.concat(F.lit("gone/"), "doc_id").alias("path"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"))))
    return manifest.tree_diff(spark, here, there).select("path", "status")


def _index(spark, d, fields):
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    docs = _table(spark, d, "documents").withColumn("about", F.concat_ws(" ", "lang", "source"))
    textindex.build(docs, "doc_id", fields, folder)
    return folder


def _bm25(field: str, words: str) -> str:
    return rf"""(WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower({field}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM (SELECT *, lang || ' ' || source AS about FROM documents)),
  s AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean_len FROM t), h AS (SELECT doc_id, len(w) AS dl, unnest(list_filter(w, lambda x: {words})) AS term FROM t),
  f AS (SELECT doc_id, dl, term, count(*) AS tf FROM h GROUP BY ALL), q AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
  SELECT doc_id AS id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))) AS score FROM f JOIN q USING (term), s GROUP BY 1)"""


@query(f"SELECT id, round(sum(score), 6) AS score FROM ({_bm25('text', "x IN ('hast', 'en') OR starts_with(x, 'fro')")} UNION ALL {_bm25('about', "x IN ('hast', 'en') OR starts_with(x, 'fro')")}) GROUP BY 1")
def search_index_two_fields(spark, d):
    """Words and the beginning of one, in two fields of a stored index."""
    return textindex.search(spark, _index(spark, d, ["text", "about"]), "hast en fro", last_as_prefix=True).withColumn("score", F.round("score", 6))


@query(f"SELECT id, round(score, 6) AS score FROM {_bm25('text', "x IN ('was', 'hast')")} ORDER BY round(score, 12) DESC, id LIMIT 20")
def search_index_top(spark, d):
    """The twenty best; blocks of postings that can't reach them are left unread."""
    return textindex.search(spark, _index(spark, d, ["text"]), "was hast", k=20).withColumn("score", F.round("score", 6))


#: A direction to look in.
_QUERY = [round(0.3 - 0.01 * i, 2) for i in range(64)]
_COSINE = "SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], [" + ", ".join(f"{x}::DOUBLE" for x in _QUERY) + "]) AS score FROM embeddings WHERE embedding IS NOT NULL"


def _vectors(spark, d):
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vectorindex.build(_table(spark, d, "embeddings"), "vec_id", "embedding", folder)
    return folder


@query(f"SELECT id, round(score, 6) AS score FROM ({_COSINE}) ORDER BY round(score, 12) DESC, id LIMIT 25")
def search_vector_index_top(spark, d):
    """The best by cosine from a stored index, read where the triangle bound lets one be."""
    return vectorindex.search(spark, _vectors(spark, d), _QUERY, 25).withColumn("score", F.round("score", 6))


@query(f"SELECT id, round(score, 6) AS score FROM ({_COSINE}) WHERE score >= 0.2")
def search_vector_index_range(spark, d):
    """All vectors with a cosine of a fifth or more."""
    return vectorindex.within(spark, _vectors(spark, d), _QUERY, 0.2).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS id, strftime(o_orderdate, '%Y-%m-%d') AS last_active, o_totalprice FROM orders)
  SELECT id, last_active, o_totalprice FROM s WHERE (last_active, id) < ('1995-06-17', '0000003000') ORDER BY last_active DESC, id DESC LIMIT 51""")
def session_page_index(spark, d):
    """A page far down a list that was stored in two runs; few files are opened for it."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    rows = _table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_active"), "o_totalprice")
    late = F.col("id").cast("long") % 4 == 0
    for run in (rows.where(~late), rows.where(late)):
        pageindex.append(run, folder, rows_a_file=2_000)
    return pageindex.page(spark, folder, 50, S.cursor_of("1995-06-17", "0000003000"))
