"""Contiguous shards of near-equal bytes, from prefix sums over partition totals.

Rows are range-partitioned and sorted by group, where a group is one text. Each partition reports its totals (a
few numbers a partition and large group, all that reaches the driver); their prefix sums place every partition,
and a second pass over the same partitions places every row.

Groups of more than `whole` of a shard's target are few (shards / whole at most), whatever the corpus. They are
placed first, by the driver, the largest first, each where most room is. A group is cut only if it is larger
than a shard, into whole shards and a rest, or if no shard has room for it. All other groups follow in order
and fill what room is left: shard k takes the bytes up to the sum of the rooms of shards 0 to k, a group
going whole where its first byte lies. So shards differ from the target by `whole` of it at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import durable

#: Groups above this part of a shard's target are placed one by one.
WHOLE = 0.02


def placed_groups(groups: list[tuple[bytes, int, int]], total: int, shards: int) -> tuple[dict[bytes, list[tuple[int, int]]], list[int]]:
    """For groups (key, rows, bytes of a row): the shards and rows of each, in order; and the bytes of room that are left in each shard."""
    upto = [total * (k + 1) // shards for k in range(shards)]
    room = [b - a for a, b in zip([0, *upto], upto)]
    places: dict[bytes, list[tuple[int, int]]] = {}
    for key, rows, size in sorted(groups, key=lambda g: (-g[1] * g[2], g[0])):
        places[key] = []
        while rows:
            k = max(range(shards), key=lambda k: (room[k], -k))
            fit = min(rows, max(1, room[k] // size)) if rows * size > room[k] else rows
            places[key].append((k, fit))
            room[k] -= fit * size
            rows -= fit
    return places, room


def shard_by_bytes(docs: DataFrame, shards: int = 40, extra: int = 16, id_col: str = "doc_id", text_col: str = "text", whole: float = WHOLE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs.

    size: UTF-8 bytes of the text (null: none) plus `extra`. shard: 0 to shards-1. slot: the row's place in
    its shard, gapless from 0. Null and empty texts are one group; null ids come first in their group; equal
    ids and texts are told apart by nothing, so that either takes either slot. No rows: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(extra)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("group"),
    )
    total = int(keyed.agg(F.sum("size")).first()[0] or 0)
    weights = keyed.groupBy("group").agg(F.count("*").alias("n"), F.min("size").alias("each")).where(F.col("n") * F.col("each") > whole * total / shards)
    large = [(bytes(r[0]), r[1], r[2]) for r in weights.collect()]  # shards / whole rows at most
    places, room = placed_groups(large, total, shards)
    number = {key: k for k, key in enumerate(sorted(places))}

    # large groups are dealt over partitions by id, others lie in one partition each
    listed = F.broadcast(docs.sparkSession.createDataFrame([(key, k) for key, k in number.items()], "group binary, large int"))
    spread = keyed.join(listed, "group", "left").withColumn("salt", F.when(F.col("large").isNotNull(), F.xxhash64("doc_id", F.monotonically_increasing_id())))
    ordered = spread.repartitionByRange("group", "salt").sortWithinPartitions("group", F.col("doc_id").asc_nulls_first()).drop("salt").withColumn("part", F.spark_partition_id())
    ordered = durable(ordered)
    sums = ordered.groupBy("part", "large").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).toPandas().sort_values("part")
    offset, before, seen, at = {}, {}, dict.fromkeys(range(len(number)), 0), 0
    for r in sums.itertuples():
        part = int(r.part)
        if np.isnan(r.large):
            offset[part] = at
            at += int(r.bytes)
        else:
            before[part, int(r.large)] = seen[int(r.large)]
            seen[int(r.large)] += int(r.n)
    limits = np.cumsum(np.maximum(room, 0))
    pieces = {number[key]: (np.cumsum([n for _, n in x]), np.array([k for k, _ in x])) for key, x in places.items()}

    def shard_of(batches):
        """Adds the shard: by the group's first byte or, for large groups, by the row's number in the group; and the row's number in its shard and partition."""
        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            if state is None:
                state = {"at": offset.get(part, 0), "start": 0, "group": None, "rows": {}, "nth": np.zeros(shards, np.int64)}
            size = batch.column("size").to_numpy()
            large = batch.column("large").fill_null(-1).to_numpy()
            group = batch.column("group")
            new = np.ones(len(size), bool)
            new[1:] = pc.not_equal(group.slice(1), group.slice(0, len(size) - 1)).to_numpy(zero_copy_only=False)
            new[0] = group[0].as_py() != state["group"]
            weight = np.where(large < 0, size, 0)
            here = state["at"] + np.cumsum(weight) - weight
            first = np.maximum.accumulate(np.where(new, np.arange(len(size)), -1))
            start = np.where(first >= 0, here[np.maximum(first, 0)], state["start"])
            shard = np.minimum(np.searchsorted(limits, start, "right"), shards - 1)
            for k in np.unique(large[large >= 0]).tolist():
                rows = np.flatnonzero(large == k)
                nth = state["rows"].get(k, before[part, k]) + np.arange(len(rows))
                state["rows"][k] = int(nth[-1]) + 1
                upto, where = pieces[k]
                shard[rows] = where[np.searchsorted(upto, nth, "right")]
            state.update(at=int(here[-1] + weight[-1]), start=int(start[-1]), group=group[len(size) - 1].as_py())
            order = np.argsort(shard, kind="stable")
            tally = np.bincount(shard, minlength=shards)
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.repeat(np.cumsum(tally) - tally, tally) + np.repeat(state["nth"], tally)
            state["nth"] += tally
            yield pa.record_batch([*(batch.column(c) for c in ("part", "doc_id", "size", "text_crc32")), pa.array(shard, pa.int32()), pa.array(nth)], names=["part", "doc_id", "size", "text_crc32", "shard", "nth"])

    sharded = durable(ordered.mapInArrow(shard_of, "part int, doc_id long, size long, text_crc32 long, shard int, nth long"))
    counts = sharded.groupBy("part", "shard").agg(F.count("*").alias("n")).toPandas().sort_values(["shard", "part"])
    counts["before"] = counts.groupby("shard")["n"].cumsum() - counts["n"]
    shift: dict[int, np.ndarray] = {}
    for r in counts.itertuples():
        shift.setdefault(int(r.part), np.zeros(shards, np.int64))[int(r.shard)] = int(r.before)

    def slots(batches):
        for batch in batches:
            if batch.num_rows:
                slot = batch.column("nth").to_numpy() + shift[batch.column("part")[0].as_py()][batch.column("shard").to_numpy()]
                yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "size", "text_crc32", "shard")), pa.array(slot)], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    return sharded.mapInArrow(slots, "doc_id long, size long, text_crc32 long, shard int, slot long")
