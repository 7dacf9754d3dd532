"""What changed between two snapshots, as one long table of changes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake.functions.equality import equivalent, key_text

#: The long form of changes: one row for each insert and delete, and for each changed field of a modified row. kinds: number, boolean or text by column, the same in all rows of a table.
CHANGES = "table_name string, change_type string, row_id string, field string, before string, after string, kinds map<string,string>"


#: Buckets of rows that are compared by sums.
BUCKETS = 1 << 18


@dataclass(frozen=True)
class Ignore:
    """Tables, fields of all tables, and fields of single tables that a diff passes over."""

    tables: frozenset[str] = frozenset()
    fields: frozenset[str] = frozenset()
    table_fields: Mapping[str, frozenset[str]] = field(default_factory=dict)

    def skips(self, table: str, column: str) -> bool:
        return column in self.fields or column in self.table_fields.get(table, ())


def paired(before: DataFrame, after: DataFrame, keys: list[str], table: str = "", ignore: Ignore = Ignore()) -> DataFrame:
    """(row_id, change_type, before, after): both rows of each key, as structs of all compared columns.

    One full outer join on the keys, which shuffles each side once. A column that one side lacks is null
    there. Keys must be unique, which check_keys tells; rows with a null key pair with nothing.
    """
    names = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c in keys or not ignore.skips(table, c)]
    kinds = {**dict(after.dtypes), **dict(before.dtypes)}
    side = lambda df, tag: df.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*((F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names)).alias(tag))
    joined = side(before, "before").join(side(after, "after"), [f"_k{i}" for i in range(len(keys))], "full_outer")
    change = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("modify")
    return joined.select(key_text([f"_k{i}" for i in range(len(keys))]).alias("row_id"), change.alias("change_type"), "before", "after")


def table_changes(before: DataFrame, after: DataFrame, keys: list[str], table: str, ignore: Ignore = Ignore()) -> DataFrame:
    """CHANGES of one table. Inserts and deletes have no field and carry the whole row as JSON."""
    both = paired(before, after, keys, table, ignore)
    fields = both.schema["before"].dataType.fields
    text = lambda side, f: F.col(f"{side}.`{f.name}`").cast("string") if f.dataType.typeName() not in ("array", "map", "struct") else F.to_json(F.col(f"{side}.`{f.name}`"))
    entries = [
        F.when(
            ~equivalent(F.col(f"before.`{f.name}`"), F.col(f"after.`{f.name}`"), f.dataType.typeName() == "string"),
            F.struct(F.lit(f.name).alias("field"), text("before", f).alias("before"), text("after", f).alias("after")),
        )
        for f in fields
        if f.name not in keys
    ]
    changed = F.filter(F.array(*entries), lambda x: x.isNotNull()) if entries else F.array().cast("array<struct<field:string,before:string,after:string>>")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.to_json("before").alias("before"), F.to_json("after").alias("after")))
    listed = both.select("row_id", "change_type", F.explode(F.when(F.col("change_type") == "modify", changed).otherwise(whole)).alias("c"))
    return listed.select(F.lit(table).alias("table_name"), "change_type", "row_id", "c.field", "c.before", "c.after", kinds_of(fields).alias("kinds"))


def kinds_of(fields) -> Column:
    """A map of each field's name to number, boolean or text."""
    kind = lambda t: "boolean" if t == "boolean" else "number" if t in ("byte", "short", "integer", "long", "float", "double", "decimal") or t.startswith("decimal") else "text"
    listed = [F.lit(x) for f in fields for x in (f.name, kind(f.dataType.typeName()))]
    return F.create_map(*listed) if listed else F.lit(None).cast("map<string,string>")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(BUCKETS))


def multiset_changes(before: DataFrame, after: DataFrame, table: str, ignore: Ignore = Ignore()) -> DataFrame:
    """CHANGES of a table without keys: rows that one side has more often are deletes or inserts, each as often; row_id is a digest of the row.

    Rows fall into buckets by a hash. Buckets whose signed count and sums of digests (96 bits) are zero hold the same
    rows on both sides; only the others' rows are shuffled, and compared as texts. Where most buckets differ, all are.
    """
    names = [c for c in before.columns if c in after.columns and not ignore.skips(table, c)]
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"})
    signed = before.select(row.alias("row"), F.lit(-1).alias("n")).unionAll(after.select(row.alias("row"), F.lit(1).alias("n")))
    hashed = signed.select("n", F.xxhash64("row").alias("h"), F.crc32(F.encode("row", "utf-8")).alias("c"), _bucket().alias("bucket"))
    sums = [F.sum(F.col("n") * x) for x in (F.lit(1), F.col("h").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("h", 32), F.col("c"))]
    differs = hashed.groupBy("bucket").agg(F.array(*(x.cast("long") for x in sums)).alias("sums")).where(F.exists("sums", lambda x: x != 0)).select("bucket")
    signed = signed.withColumn("bucket", _bucket()).join(F.broadcast(differs), "bucket", "left_semi")  # BUCKETS at most
    net = signed.groupBy("row").agg(F.sum("n").alias("n")).where("n <> 0")
    each = net.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))))
    insert = F.col("n") > 0
    return each.select(F.lit(table).alias("table_name"), F.when(insert, "insert").otherwise("delete").alias("change_type"), F.md5("row").alias("row_id"), F.lit(None).cast("string").alias("field"), F.when(~insert, F.col("row")).alias("before"), F.when(insert, F.col("row")).alias("after"), kinds_of([before.schema[c] for c in names]).alias("kinds"))


def snapshot_changes(before, after, ignore: Ignore = Ignore()) -> DataFrame:
    """CHANGES of all tables of two snapshots. A table that one side lacks counts as empty there."""
    names = [t for t in sorted({*before.tables(), *after.tables()}) if t not in ignore.tables]
    parts = []
    for t in names:
        left = before.frames.get(t)
        right = after.frames.get(t)
        left, right = (left if left is not None else right.limit(0)), (right if right is not None else left.limit(0))
        keys = before.keys.get(t) or after.keys.get(t)
        parts.append(table_changes(left, right, keys, t, ignore) if keys else multiset_changes(left, right, t, ignore))
    return reduce(DataFrame.unionAll, parts) if parts else before.spark.createDataFrame([], CHANGES)


def totals(changes: DataFrame) -> DataFrame:
    """(table_name, change_type, n): changed rows."""
    return changes.groupBy("table_name", "change_type").agg(F.count_distinct("row_id").alias("n"))


def check_keys(rows: DataFrame, keys: list[str]) -> None:
    """ValueError if a key is null or occurs twice."""
    bad = rows.groupBy(*keys).count().where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.col("count") > 1)).limit(3).collect()
    if bad:
        raise ValueError(f"null or repeated keys: {[r.asDict() for r in bad]}")


def table_set_changes(before: list[str], after: list[str], spark) -> DataFrame:
    """(table_name, status: added or removed)."""
    left, right = (spark.createDataFrame([(t,) for t in x], "table_name string") for x in (before, after))
    return right.subtract(left).withColumn("status", F.lit("added")).unionAll(left.subtract(right).withColumn("status", F.lit("removed")))
