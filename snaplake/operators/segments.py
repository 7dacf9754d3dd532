"""Running values over sessions of any length: a session is cut by position, and carries pass from cut to cut.

A window over a session sorts it in one task. Here rows are range-partitioned by session and position, so that
every part has about as many rows, however few sessions there are. Each part is folded to what it hands on for
the sessions at its ends (at most two rows a part); these are run along, and the windows within parts take up
from there. Positions must be unique within a session, as for the windows; rows without a session are one of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaplake.catalog import durable

PART, KEY = "_part", "_session"


def parted(events: DataFrame, session: str, seq: str, parts: int) -> DataFrame:
    """events with _session (never null) and _part: the number of the range of session and position that a row is in. Written once, as the ranges come from a sample."""
    return durable(events.withColumn(KEY, F.struct(session)).repartitionByRange(parts, KEY, seq).withColumn(PART, F.spark_partition_id()))


def carries(rows: DataFrame, folded: Column) -> DataFrame:
    """(_session, _part, carry) for the sessions that are in several parts: two rows a part at most, as the others lie within one."""
    ends = rows.groupBy(PART).agg(F.min(KEY).alias("low"), F.max(KEY).alias("high")).select(PART, F.explode(F.array("low", "high")).alias(KEY))
    shared = ends.distinct().groupBy(KEY).agg(F.count("*").alias("n")).where("n > 1").select(KEY)
    return durable(rows.join(F.broadcast(shared), KEY, "left_semi").groupBy(KEY, PART).agg(folded.alias("carry")))


def _taken_up(rows: DataFrame, found: DataFrame, carried: Column, parts: int) -> DataFrame:
    """rows, a part in each task again, with what was carried to their part (null: nothing). The carries are no more than twice the parts."""
    handed = found.select(KEY, PART, carried.alias("_carry"))
    return rows.repartitionById(parts, PART).join(F.broadcast(handed), [KEY, PART], "left")


def _within():
    return Window.partitionBy(PART, KEY)


def _parts(order):
    """The parts of a session up to the one before, in this order."""
    return Window.partitionBy(KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running_from_end(events: DataFrame, session: str, seq: str, cost: Column, parts: int) -> DataFrame:
    """events with cost, and running: the sum of costs from a row to the end of its session."""
    rows = parted(events.withColumn("cost", cost), session, seq, parts)
    taken = _taken_up(rows, carries(rows, F.sum("cost")), F.sum("carry").over(_parts(F.desc(PART))), parts)
    here = F.sum("cost").over(_within().orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, 0))
    total = F.when(here.isNotNull() | F.col("_carry").isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce("_carry", F.lit(0)))
    return taken.withColumn("running", total).select(*events.columns, "cost", "running")


def last_known(events: DataFrame, session: str, seq: str, value: Column, name: str, parts: int) -> DataFrame:
    """events with the last value that isn't null up to each row, and whether it differs from that of the row before."""
    rows = parted(events.withColumn("_v", value), session, seq, parts)
    folded = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(seq)))
    taken = _taken_up(rows, carries(rows, folded), F.last("carry", ignorenulls=True).over(_parts(F.asc(PART))), parts)
    ordered = _within().orderBy(seq)
    taken = taken.withColumn("_here", F.last("_v", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("_here").over(ordered), F.col("_carry"))
    out = taken.withColumn("_before", before).withColumn(name, F.coalesce("_here", "_carry"))
    changed = F.coalesce((F.col("_before") != F.col(name)) & F.col("_before").isNotNull(), F.lit(False))
    return out.withColumn(f"{name}_changed", changed).select(*events.columns, name, f"{name}_changed")


def value_before(events: DataFrame, session: str, seq: str, name: str, parts: int) -> DataFrame:
    """events with `previous`: the value of the row before in its session, null or not."""
    rows = parted(events, session, seq, parts)
    folded = F.max_by(F.struct(F.col(name).alias("v")), seq)
    taken = _taken_up(rows, carries(rows, folded), F.lag("carry").over(Window.partitionBy(KEY).orderBy(PART)), parts)
    ordered = _within().orderBy(seq)
    first = F.row_number().over(ordered) == 1
    return taken.withColumn("previous", F.when(first, F.col("_carry.v")).otherwise(F.lag(name).over(ordered))).select(*events.columns, "previous")
