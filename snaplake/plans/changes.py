"""Diffs of two snapshots of orders, and checks of what changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.functions.equality import equivalent
from snaplake.operators import diff, invariants
from snaplake.operators.sync import manifest_diff, manifest_root

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pair(spark, d):
    """orders, and orders with some rows deleted, changed and added."""
    before = spark.read.parquet(f"{d}/orders.parquet")
    kept = before.where("o_orderkey % 97 <> 3").withColumns({
        "o_orderstatus": F.expr("case when o_orderkey % 50 = 7 then 'X' else o_orderstatus end"),
        "o_totalprice": F.expr("case when o_orderkey % 89 = 5 then o_totalprice + 1 else o_totalprice end"),
    })
    return before, kept.unionAll(before.where("o_orderkey % 211 = 5").withColumn("o_orderkey", F.expr("o_orderkey + 1000000000")))


_AFTER = """after_ AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 89 = 5 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 3
  UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 211 = 5),
both_ AS (SELECT b.o_orderkey AS bk, a.o_orderkey AS ak, b.o_orderstatus AS bs, a.o_orderstatus AS as_, b.o_totalprice AS bp, a.o_totalprice AS ap FROM orders b FULL JOIN after_ a ON a.o_orderkey = b.o_orderkey),
changes AS (SELECT CASE WHEN bk IS NULL THEN 'insert' ELSE 'delete' END AS change_type, coalesce(bk, ak) AS k, NULL AS field FROM both_ WHERE bk IS NULL OR ak IS NULL
  UNION ALL SELECT 'modify', bk, 'o_orderstatus' FROM both_ WHERE bk = ak AND bs IS DISTINCT FROM as_
  UNION ALL SELECT 'modify', bk, 'o_totalprice' FROM both_ WHERE bk = ak AND bp IS DISTINCT FROM ap)"""


def _changes(spark, d, ignore=diff.Ignore()):
    before, after = _pair(spark, d)
    return diff.table_changes(before, after, ["o_orderkey"], "orders", ignore)


def _shown(changes):
    return changes.select("change_type", F.col("row_id").cast("bigint").alias("k"), "field")


@query(f"WITH {_AFTER} SELECT change_type, k, field FROM changes")
def diff_orders_long(spark, d):
    return _shown(_changes(spark, d))


@query(f"WITH {_AFTER} SELECT change_type, count(DISTINCT k) AS n FROM changes GROUP BY change_type")
def diff_orders_totals(spark, d):
    return diff.totals(_changes(spark, d)).select("change_type", "n")


@query(f"WITH {_AFTER} SELECT change_type, k, field FROM changes WHERE field IS NULL OR field <> 'o_totalprice'")
def diff_ignore_fields(spark, d):
    return _shown(_changes(spark, d, diff.Ignore(table_fields={"orders": frozenset({"o_totalprice"})})))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 101 = 1 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, count(*) AS n FROM lineitem WHERE l_orderkey % 103 <> 2 GROUP BY ALL)
  SELECT CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'insert' ELSE 'delete' END AS change_type, CAST(sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0))) AS BIGINT) AS n
  FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity = b.l_quantity WHERE coalesce(a.n, 0) <> coalesce(b.n, 0) GROUP BY 1""")
def diff_multiset(spark, d):
    before = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    after = before.where("l_orderkey % 103 <> 2").withColumn("l_quantity", F.expr("case when l_orderkey % 101 = 1 then l_quantity + 1 else l_quantity end"))
    return diff.multiset_changes(before, after, "lineitem").groupBy("change_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_id % 3 <> 1 AS same FROM events")
def diff_json_equivalence(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k")
    left = F.format_string('{"a": [1, 2], "k": %s}', k)
    right = F.when(F.expr("event_id % 3 = 1"), F.format_string('{"k":%s,"a":[2,1]}', k)).otherwise(F.format_string(' {"k":%s,\t"a":[1,2]} ', k))
    return e.select("event_id", equivalent(left, right, True).alias("same"))


@query("SELECT * FROM (VALUES ('lineitem', 'removed'), ('audit', 'added')) t(table_name, status)")
def diff_added_tables(spark, d):
    return diff.table_set_changes(["orders", "lineitem"], ["orders", "audit"], spark)


def _specs():
    return [{"table": "orders", "pk": 7, "type": "modify", "resulting_fields": [("o_orderstatus", "X")], "no_other_changes": True}, {"table": "orders", "pk": 57, "type": "modify", "resulting_fields": [("o_orderstatus", "Y")], "no_other_changes": True}, {"table": "orders", "pk": 3, "type": "delete"}, {"table": "orders", "pk": 1, "type": "delete"}, {"table": "orders", "pk": 1000000005, "type": "insert", "fields": None}, {"table": "orders", "pk": 107, "field": "o_orderstatus", "after": ...}]


_ALLOWED = "NOT (change_type = 'modify' AND k IN (7, 107) AND field = 'o_orderstatus') AND NOT (change_type = 'delete' AND k = 3) AND NOT (change_type = 'insert' AND k = 1000000005)"
_PROBLEM = "CASE WHEN change_type = 'modify' AND k = 57 AND field = 'o_orderstatus' THEN 'value' WHEN change_type = 'modify' AND k IN (7, 57, 107) THEN 'field' ELSE 'unexpected' END"


@query(f"WITH {_AFTER} SELECT change_type, k, {_PROBLEM} AS problem FROM changes WHERE {_ALLOWED} GROUP BY ALL")
def expect_only_violations(spark, d):
    return invariants.expect_only(_changes(spark, d), _specs()).select("change_type", F.col("row_id").cast("bigint").alias("k"), "problem").distinct()


@query(f"WITH {_AFTER} SELECT change_type, k, {_PROBLEM} AS problem FROM changes WHERE {_ALLOWED} GROUP BY ALL UNION ALL SELECT 'delete', 1, 'missing' UNION ALL SELECT 'modify', 107, 'unexpected' WHERE false")
def expect_exactly_report(spark, d):
    specs = [s for s in _specs() if "type" in s] + [{"table": "orders", "pk": 107, "type": "modify", "resulting_fields": [("o_orderstatus", ...)], "no_other_changes": True}]
    return invariants.expect_exactly(_changes(spark, d), specs).select("change_type", F.col("row_id").cast("bigint").alias("k"), "problem").distinct()


@query(f"WITH {_AFTER} SELECT change_type, k, field FROM changes WHERE field IS NULL OR field = 'o_totalprice'")
def expect_allow_forbid(spark, d):
    return _shown(invariants.expect(_changes(spark, d), allow=[{"table": "orders", "field": "o_orderstatus"}, {"table": "orders", "field": "o_totalprice"}], forbid=[{"table": "orders", "field": "o_totalprice"}]))


@query(f"WITH {_AFTER} SELECT DISTINCT 1 AS expected, k AS found FROM changes WHERE change_type = 'delete' AND k <> 3")
def near_match_hints(spark, d):
    return invariants.near_matches(_changes(spark, d), [s for s in _specs() if "type" in s]).select(F.col("expected_row").cast("int").alias("expected"), F.col("found_row").cast("bigint").alias("found"))


@query("SELECT 'orders' AS table_name, count(*) AS before_n, count(*) FILTER (o_orderkey % 97 <> 3) + count(*) FILTER (o_orderkey % 211 = 5) AS after_n FROM orders HAVING before_n <> after_n")
def no_change_counts(spark, d):
    before, after = (x.agg(F.count("*").alias("n")).select(F.lit("orders").alias("table_name"), "n") for x in _pair(spark, d))
    return invariants.count_changes(before, after)


@query("""WITH l AS (SELECT 'd/' || doc_id AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 11 <> 4), r AS (SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 7 = 1 THEN 'x' ELSE sha256(text) END AS sha256 FROM documents WHERE doc_id % 5 <> 2)
  SELECT coalesce(l.path, r.path) AS path, coalesce(l.sha256, r.sha256) AS sha256, CASE WHEN r.path IS NULL THEN 'new' WHEN l.path IS NULL THEN 'removed' ELSE 'changed' END AS status FROM l FULL JOIN r ON l.path = r.path WHERE l.sha256 IS DISTINCT FROM r.sha256""")
def manifest_changes(spark, d):
    files = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("d/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    remote = files.where("doc_id % 5 <> 2").withColumn("sha256", F.expr("case when doc_id % 7 = 1 then 'x' else sha256 end"))
    return manifest_diff(files.where("doc_id % 11 <> 4"), remote, removed=True)


@query("""WITH f AS (SELECT 'd/' || doc_id AS path, sha256(text) AS s FROM documents), p AS (SELECT left(sha256(path), 3) AS bucket, count(*) AS n, sha256(string_agg(path || chr(9) || s, chr(10) ORDER BY path || chr(9) || s)) AS leaf FROM f GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(bucket || chr(9) || leaf, chr(10) ORDER BY bucket)) AS root FROM p""")
def manifest_root_hash(spark, d):
    return manifest_root(spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256")))


@query("SELECT CAST(page_id AS VARCHAR) AS page, CASE WHEN page_id % 13 = 1 THEN 'delete' ELSE 'modify' END AS change_type FROM pages WHERE page_id % 13 = 1 OR page_id % 17 = 2")
def file_diff(spark, d):
    before = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")
    after = before.where("page_id % 13 <> 1").withColumn("html", F.expr("case when page_id % 17 = 2 then concat(html, '.') else html end"))
    return diff.table_changes(before, after, ["page_id"], "pages").select(F.col("row_id").alias("page"), "change_type")
