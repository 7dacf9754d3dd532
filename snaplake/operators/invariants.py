"""Whether a table of changes is what was allowed or expected.

A spec is a dict with `table`, `pk` and either `type` ('insert', 'delete', 'modify') with optional `fields`
(insert, delete) or `resulting_fields` and `no_other_changes` (modify), or the older form `field` and `after`
('__added__' and '__removed__' with field None stand for whole rows). Values are three-state: a value must be
equal, None must be null, ... (Ellipsis) may be anything. Specs are few (they are written by hand), so they
are sent along with the join; changes stay distributed and only violations come out.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snaplake.functions.equality import canonical_json, key_text
from snaplake.operators.diff import Ignore, table_changes

#: The most specs that are broadcast; more are joined by shuffle.
BROADCAST_SPECS = 10_000
_SPEC = "table_name string, row_id string, type string, fields map<string, struct<any: boolean, value: string, number: boolean>>, closed boolean, nth int"


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (dict, list)):
        return json.dumps(value)
    return str(value)


def _wanted(value) -> tuple[bool, str | None, bool]:
    """(any, value as text, whether it is a number)."""
    return value is ..., None if value is ... else _text(value), isinstance(value, (bool, int, float))


def _key(pk) -> str:
    return "(" + ", ".join(str(x) for x in pk) + ")" if isinstance(pk, (list, tuple)) else str(pk)


def spec_table(spark: SparkSession, specs: list[dict], exact: bool = False) -> DataFrame:
    """The specs as rows; older specs of one row are joined to one. Of specs for the same table, key and type the last holds."""
    merged: dict[tuple, list] = {}
    for spec in specs:
        key = (spec["table"], _key(spec["pk"]))
        if "type" in spec:
            kind = spec["type"]
            if kind not in ("insert", "delete", "modify"):
                raise ValueError(f"type {kind!r}")
            given = spec.get("resulting_fields") if kind == "modify" else spec.get("fields")
            if kind == "modify" and given is not None and not isinstance(spec.get("no_other_changes"), bool):
                raise ValueError("resulting_fields needs no_other_changes, true or false")
            closed = given is not None and (spec["no_other_changes"] if kind == "modify" else kind == "insert" or not exact)
            merged[(*key, kind)] = [None if given is None else {f: _wanted(v) for f, v in given}, closed]
        elif spec.get("field") is None:
            kind = {"__added__": "insert", "__removed__": "delete"}.get(spec.get("after"))
            if kind is None:
                raise ValueError("a spec without field needs after '__added__' or '__removed__'")
            merged[(*key, kind)] = [None, False]
        else:
            entry = merged.setdefault((*key, "modify"), [{}, True])
            entry[0] = {**(entry[0] or {}), spec["field"]: _wanted(spec["after"])}
    rows = [(t, k, kind, fields, closed, n) for n, ((t, k, kind), (fields, closed)) in enumerate(merged.items())]
    return spark.createDataFrame(rows, _SPEC)


def _fields_of(changes: DataFrame) -> DataFrame:
    """A row for each field of each changed row, with the value that specs speak of: after a change, or of the deleted row."""
    value = F.when(F.col("change_type") == "delete", F.col("before")).otherwise(F.col("after"))
    whole = F.map_entries(F.from_json(value, "map<string,string>"))
    one = F.array(F.struct(F.col("field").alias("key"), F.col("after").alias("value")))
    kinds = F.col("kinds") if "kinds" in changes.columns else F.lit(None).cast("map<string,string>")
    return changes.select("table_name", "change_type", "row_id", kinds.alias("kinds"), F.explode_outer(F.when(F.col("change_type") == "modify", one).otherwise(whole)).alias("f"))


def _equal(value, number, want):
    """value (number: whether its column holds numbers, null if that isn't known) is what the spec wants."""
    as_number = F.when(value == "true", 1.0).when(value == "false", 0.0).otherwise(value.try_cast("double"))
    same_number = F.coalesce(as_number == want["value"].try_cast("double"), F.lit(False))
    same_text = (value == want["value"]) | F.coalesce(canonical_json(value) == canonical_json(want["value"]), F.lit(False))
    both_null = value.isNull() & want["value"].isNull()
    known = F.when(want["number"], F.when(F.coalesce(number, F.lit(True)), same_number)).when(~F.coalesce(number, F.lit(False)), same_text)
    return both_null | F.coalesce(known, F.lit(False))


def _joined(changes: DataFrame, specs: DataFrame, n_specs: int) -> DataFrame:
    """Each field with its spec, and what is wrong with it: null, 'unexpected', 'field' (not listed), 'value'."""
    kind = F.try_element_at("kinds", F.col("f.key"))
    fields = _fields_of(changes).select("table_name", "change_type", "row_id", F.col("f.key").alias("field"), F.col("f.value").alias("value"), kind.isin("number", "boolean").alias("number"))
    right = specs.withColumnRenamed("type", "change_type")
    right = F.broadcast(right) if n_specs <= BROADCAST_SPECS else right
    both = fields.join(right, ["table_name", "change_type", "row_id"], "left")
    want = F.try_element_at("fields", F.col("field"))
    equal = _equal(F.col("value"), F.col("number"), want)
    problem = (
        F.when(F.col("nth").isNull(), "unexpected")
        .when(F.col("fields").isNull() | F.col("field").isNull(), F.lit(None))
        .when(want.isNull(), F.when(F.col("closed"), "field"))
        .when(~want["any"] & ~equal, "value")
    )
    return both.select("table_name", "change_type", "row_id", "field", "value", want["value"].alias("expected"), problem.alias("problem"))


def expect_only(changes: DataFrame, specs: list[dict]) -> DataFrame:
    """(table_name, change_type, row_id, field, value, expected, problem) of every change that no spec allows. Rows without a spec show their fields one by one."""
    return _joined(changes, spec_table(changes.sparkSession, specs), len(specs)).where("problem is not null")


def expect_exactly(changes: DataFrame, specs: list[dict]) -> DataFrame:
    """As expect_only, and with problem 'missing' each spec that no change answers. Specs need a type."""
    if any("type" not in s for s in specs):
        raise ValueError("every spec needs a type")
    table = spec_table(changes.sparkSession, specs, exact=True)
    found = _joined(changes, table, len(specs)).where("problem is not null")
    seen = changes.select("table_name", F.col("change_type").alias("type"), "row_id").distinct()
    missing = table.join(seen, ["table_name", "type", "row_id"], "left_anti")
    none = F.lit(None).cast("string")
    return found.unionAll(missing.select("table_name", F.col("type"), "row_id", none, none, none, F.lit("missing")))


def near_matches(changes: DataFrame, specs: list[dict], most: int | None = None) -> DataFrame:
    """(table_name, change_type, expected_row, found_row): for each spec that is missing, the changes of its kind that no spec names; of each kind the first `most` by row_id, if that is given."""
    table = spec_table(changes.sparkSession, specs, exact=True).withColumnRenamed("type", "change_type")
    table = F.broadcast(table) if len(specs) <= BROADCAST_SPECS else table
    seen = changes.select("table_name", "change_type", "row_id").distinct()
    missing = table.join(seen, ["table_name", "change_type", "row_id"], "left_anti").select("table_name", "change_type", F.col("row_id").alias("expected_row"))
    rest = seen.join(table, ["table_name", "change_type", "row_id"], "left_anti").select("table_name", "change_type", F.col("row_id").alias("found_row"))
    if most is not None:  # each task keeps as many of a kind before the shuffle
        first = F.row_number().over(Window.partitionBy("table_name", "change_type").orderBy("found_row"))
        rest = rest.withColumn("nth", first).where(F.col("nth") <= most).drop("nth")
    return missing.join(rest, ["table_name", "change_type"])


def expect_targeted(before: DataFrame, after: DataFrame, keys: list[str], table: str, specs: list[dict], ignore: Ignore = Ignore()) -> DataFrame:
    """As expect_only for one table, but only the rows that specs name are compared; of all others, numbers of rows.

    The rows are picked by key before the join, so that the tables are read and counted, not shuffled. Problem
    'count' tells that the numbers of rows differ by something else than the rows that specs add and delete.
    """
    spark = before.sparkSession
    named = list(dict.fromkeys(_key(s["pk"]) for s in specs))
    picked = F.broadcast(spark.createDataFrame([(k,) for k in named], "row_id string")) if len(named) <= BROADCAST_SPECS else spark.createDataFrame([(k,) for k in named], "row_id string")
    chosen = [x.join(picked, key_text(keys) == F.col("row_id"), "left_semi") for x in (before, after)]
    changes = table_changes(*chosen, keys, table, ignore)
    wrong = expect_only(changes, specs)
    moved = changes.agg(F.count_if(F.col("change_type") == "insert").alias("added"), F.count_if(F.col("change_type") == "delete").alias("gone"))
    rows = before.agg(F.count("*").alias("b")).crossJoin(after.agg(F.count("*").alias("a"))).crossJoin(moved)  # one row each
    none = F.lit(None).cast("string")
    off = rows.where("b + added - gone <> a").select(F.lit(table).alias("table_name"), F.lit("table").alias("change_type"), none.alias("row_id"), none.alias("field"), F.col("a").cast("string").alias("value"), F.expr("cast(b + added - gone as string)").alias("expected"), F.lit("count").alias("problem"))
    return wrong.unionByName(off)


def unchanged(before, after, ignore: Ignore = Ignore()) -> DataFrame:
    """(table_name, before_n, after_n, same) of every table of two snapshots: its rows and their digests, added up, agree.

    One pass over each table and side, whatever its size, without a shuffle; digests are of 64 bits. A table
    that one side lacks has no rows there.
    """
    names = [t for t in sorted({*before.tables(), *after.tables()}) if t not in ignore.tables]

    def told(side, other, t):
        if t not in side.frames:
            return side.spark.range(0).agg(F.count("*").alias("n"), F.lit(None).cast("decimal(38,0)").alias("digest"))
        columns = [c for c in sorted(side.frames[t].columns) if not ignore.skips(t, c)]
        rows = F.xxhash64(*(F.struct(F.lit(c), F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in columns))
        return side.frames[t].agg(F.count("*").alias("n"), F.sum(rows.cast("decimal(20,0)")).alias("digest"))

    parts = []
    for t in names:
        left, right = told(before, after, t), told(after, before, t)
        both = left.select(F.col("n").alias("before_n"), F.col("digest").alias("b")).crossJoin(right.select(F.col("n").alias("after_n"), F.col("digest").alias("a")))  # one row each
        parts.append(both.select(F.lit(t).alias("table_name"), "before_n", "after_n", F.expr("before_n = after_n and b <=> a").alias("same")))
    return reduce(DataFrame.unionAll, parts)


def expect(changes: DataFrame, allow: list[dict] | None = None, forbid: list[dict] | None = None) -> DataFrame:
    """Changes outside `allow` (if given) or within `forbid`, lists of {table, field}; field None stands for inserts and deletes."""
    match = lambda rules: reduce(lambda a, b: a | b, [(F.col("table_name") == r["table"]) & F.col("field").eqNullSafe(F.lit(r.get("field"))) for r in rules], F.lit(False))
    bad = match(forbid or [])
    if allow is not None:
        bad = bad | ~match(allow)
    return changes.where(bad)


def count_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, before_n, after_n) of tables whose row counts differ, from two counts tables."""
    both = before.withColumnRenamed("n", "before_n").join(after.withColumnRenamed("n", "after_n"), "table_name", "full_outer")
    return both.where("not before_n <=> after_n")


def row_expectations(rows: DataFrame, conditions: list[dict]) -> DataFrame:
    """(nth, n, met): of each condition (equalities), the rows that meet it. One pass for all."""
    terms = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in condition.items()], F.lit(True)) for condition in conditions]
    counts = rows.agg(*(F.count_if(t).alias(f"n{i}") for i, t in enumerate(terms)))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("nth"), F.col(f"n{i}").alias("n")) for i in range(len(terms)))))
    return counts.select(each.alias("r")).select("r.nth", "r.n", (F.col("r.n") > 0).alias("met"))


def report(violations: DataFrame, most: int = 5) -> str:
    """The first violations as text; empty if there are none."""
    rows = violations.orderBy("table_name", "row_id", "field").limit(most + 1).collect()
    lines = [f"{r['table_name']} {r['change_type']} {r['row_id']}: {r['field'] or 'row'} {r['problem']}, is {r['value']!r}, expected {r['expected']!r}" for r in rows[:most]]
    return "\n".join(lines + (["... and more"] if len(rows) > most else []))
