"""Queries by the fluent builder."""

from __future__ import annotations

from pyspark.sql import functions as F

from snaplake.catalog import Snapshot
from snaplake.functions import text as T
from snaplake.operators import rollups
from snaplake.operators.invariants import row_expectations

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, o_totalprice, p_brand, s_name FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE o_orderstatus = 'F' AND l_quantity >= 45 AND p_size <= 10""")
def builder_star_join(spark, d):
    q = Snapshot.load(spark, d).table("lineitem").join("orders", {"l_orderkey": "o_orderkey"}).join("part", {"l_partkey": "p_partkey"}).join("supplier", {"l_suppkey": "s_suppkey"})
    return q.eq("o_orderstatus", "F").gte("l_quantity", 45).lte("p_size", 10).select("l_orderkey", "l_linenumber", "l_extendedprice", "o_totalprice", "p_brand", "s_name").df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def builder_select_filter_sort_limit(spark, d):
    q = Snapshot.load(spark, d).table("orders").eq("o_orderstatus", "O").gt("o_totalprice", 1000)
    return q.select("o_orderkey", "o_totalprice").df().orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('F')")
def builder_in_not_in(spark, d):
    return Snapshot.load(spark, d).table("orders").in_("o_orderpriority", ["1-URGENT", "5-LOW"]).not_in("o_orderstatus", ["F"]).select("o_orderkey", "o_orderpriority").df()


@query("SELECT (SELECT count(*) FROM orders WHERE false) AS n_in, (SELECT count(*) FROM orders WHERE true) AS n_not_in")
def builder_in_empty(spark, d):
    t = Snapshot.load(spark, d).table("orders")
    return t.in_("o_orderkey", []).count_df().withColumnRenamed("n", "n_in").crossJoin(t.not_in("o_orderkey", []).count_df().withColumnRenamed("n", "n_not_in"))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderstatus, 'P') IS NULL AS missing FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL OR nullif(o_orderstatus, 'P') <> 'F'")
def builder_null_predicates(spark, d):
    t = Snapshot.load(spark, d).table("orders")
    status = "nullif(o_orderstatus, 'P')"
    return t.is_null(status).select("o_orderkey", f"{status} AS status", f"{status} IS NULL AS missing").df().unionAll(t.not_null(status).neq(status, "F").select("o_orderkey", f"{status} AS status", f"{status} IS NULL AS missing").df())


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type ILIKE '%brass%' OR p_name ILIKE '%1'")
def builder_ilike(spark, d):
    t = Snapshot.load(spark, d).table("part").select("p_partkey", "p_name", "p_type")
    return t.ilike("p_type", "%BRASS%").df().union(t.ilike("p_name", "%1").df()).distinct()


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def builder_where_dict(spark, d):
    return Snapshot.load(spark, d).table("customer").where({"c_mktsegment": "BUILDING"}, c_nationkey=7).select("c_custkey", "c_acctbal").df()


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_acctbal < 0")
def builder_count(spark, d):
    return Snapshot.load(spark, d).table("orders").join("customer", {"o_custkey": "c_custkey"}).eq("o_orderstatus", "F").lt("c_acctbal", 0).count_df()


@query("SELECT o_orderkey FROM orders WHERE NOT (nullif(o_orderstatus, 'P') IS DISTINCT FROM NULL)")
def builder_eq_null_safe(spark, d):
    return Snapshot.load(spark, d).table("orders").eq_null_safe("nullif(o_orderstatus, 'P')", None).select("o_orderkey").df()


@query("SELECT 0 AS nth, count(*) AS n, count(*) > 0 AS met FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 UNION ALL SELECT 1, count(*), count(*) > 0 FROM customer WHERE c_mktsegment = 'NONE'")
def row_expectation_counts(spark, d):
    return row_expectations(Snapshot.load(spark, d).frame("customer"), [{"c_mktsegment": "BUILDING", "c_nationkey": 3}, {"c_mktsegment": "NONE"}])


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")))
def table_counts(spark, d):
    return Snapshot.load(spark, d).counts()


@query("""SELECT c_custkey, c_name FROM customer c WHERE c_mktsegment = 'MACHINERY' AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')""")
def semi_anti_chain(spark, d):
    s = Snapshot.load(spark, d)
    orders, on = s.frame("orders"), {"c_custkey": "o_custkey"}
    out = s.table("customer").eq("c_mktsegment", "MACHINERY").having(orders.where("o_orderstatus = 'F'"), on).having(orders.where("o_orderpriority = '1-URGENT'"), on, without=True)
    return out.select("c_custkey", "c_name").df()


@query("SELECT coalesce(nullif(o_orderstatus, 'P'), '') AS status, o_orderpriority AS priority, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2")
def group_composite_key(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.expr("nullif(o_orderstatus, 'P')").alias("status"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return rollups.by_key(orders, ["status", "priority"], "o_orderkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND event_type = 'purchase'")
def json_field_presence(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'purchase'")
    return e.where(T.json_has(F.col("props"), "k")).select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
