"""Helpers that several operators share: durable cut points, connected components, pairing within buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.catalog import durable

#: Links that one task may finish by itself in connected_components; beyond it the distributed rounds go on.
FINISH_LINKS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, rows: int = 500, size: int = 8_000_000):
    """The batch in parts of at most `rows` rows and, but for single rows, `size` bytes in the column."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right"))
        stop = min(batch.num_rows, at + rows, max(at + 1, upto))
        yield batch.slice(at, stop - at)
        at = stop


def tasks(df: DataFrame) -> int:
    """Partitions for work that costs more than its bytes tell: as many as the session shuffles into, where Spark would put small ones together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it no column of df (cases count as equal)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b as stars: every node with the smallest node that it reaches, itself left out."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = np.minimum(new, new[label])
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def stars(batches):
    """Per partition: links to stars, in bounded memory (folded whenever a few million wait).

    What finds links in Python folds them there: two mapInArrow in a row take two Python workers a task, and an
    executor keeps all that it ever had, as it uses them in turn.
    """
    held_a, held_b, n = [], [], 0
    for batch in batches:
        held_a.append(batch.column("a").to_numpy(zero_copy_only=False))
        held_b.append(batch.column("b").to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n > 4_000_000:
            a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
            held_a, held_b, n = [a], [b], len(a)
    if n:
        a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
        for i in range(0, len(a), 100_000):
            yield pa.record_batch([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours, linked to the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself, linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def connected_components(links: DataFrame, finish: int = FINISH_LINKS, folded: bool = False) -> DataFrame:
    """(id, component) for every node of links (a, b: long) that isn't its component's smallest node.

    Links are first folded to stars within each partition, unless they come folded. While more than `finish` links remain, rounds
    of large-star and small-star (Kiveris et al., 2014) shrink them over the cluster; what fits one task
    is finished there. No links, nulls or loops: no rows for them.
    """
    links = links.select("a", "b").where("a <> b")
    held = durable(links if folded else links.mapInArrow(stars, "a long, b long"))
    left, seen = held.count(), None
    while left > finish:
        held = durable(_small_star(_large_star(held)))
        left, total = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (left, total) == seen:
            return held.select(F.col("a").alias("id"), F.col("b").alias("component"))
        seen = (left, total)
    done = held.repartition(1).mapInArrow(stars, "a long, b long")
    return durable(done.select(F.col("a").alias("id"), F.col("b").alias("component")))


def block_links(large: DataFrame, compare, block: int, reach: int | None = None, fold: bool = False) -> DataFrame:
    """(a, b) that compare finds among the rows of each large group, a pair of blocks at a time; fold: as stars, by partition.

    large: key, nth (long: number of the row in its group, from 0), by (long) and whatever compare reads. `block`
    numbers in a row are one block; every pair of blocks whose ranges of `by` are at most `reach` apart (None:
    every pair) goes to a task of its own, so that no task holds more than two blocks of a group however large
    it is. compare(left, right, same) takes two record batches and gives arrays a, b.
    """
    large = large.withColumn("own", F.floor(F.col("nth") / block).cast("int"))
    ranges = large.groupBy("key", "own").agg(F.min("by").alias("low"), F.max("by").alias("high"))
    left, right = ranges.select("key", F.col("own").alias("lo"), F.col("high").alias("upto")), ranges.select("key", F.col("own").alias("hi"), F.col("low").alias("since"))
    near = F.lit(True) if reach is None else F.col("since") - F.col("upto") <= reach
    couples = left.join(right, "key").where(F.col("lo") <= F.col("hi")).where(near).select("key", "lo", "hi")
    sides = couples.select("key", "lo", "hi", F.col("lo").alias("own")).unionByName(couples.where("lo < hi").select("key", "lo", "hi", F.col("hi").alias("own")))
    names = [c for c in large.columns if c not in ("nth", "by", "own")]
    dealt = large.join(sides, ["key", "own"]).select(*names, "lo", "hi", "own")
    order = ["key", "lo", "hi"]

    def run(batches):
        now, held = None, []

        def closed():
            rows = pa.Table.from_batches(held).combine_chunks()
            own, lo, hi = (rows.column(c).to_numpy() for c in ("own", "lo", "hi"))
            first = rows.filter(pa.array(own == lo)).combine_chunks().to_batches()[0]
            same = bool(lo[0] == hi[0])
            second = first if same else rows.filter(pa.array(own == hi)).combine_chunks().to_batches()[0]
            a, b = compare(first, second, same)
            for i in range(0, len(a), 50_000):
                yield pa.record_batch([pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in order])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                key = tuple(at[:, low])
                if key != now and held:
                    yield from closed()
                    held = []
                now = key
                held.append(batch.slice(low, high - low))
        if held:
            yield from closed()

    return dealt.repartition(tasks(large), *order).sortWithinPartitions(*order, "own").mapInArrow((lambda batches: stars(run(batches))) if fold else run, "a long, b long")


def bucket_pairs(entries: DataFrame, pairs, forest_only: bool, block: int = 2048) -> DataFrame:
    """(a, b) for the pairs of entries (key, id, sig..: long) of one key that pairs(left, right) lets through.

    pairs takes two arrays of as many rows, a column for each sig, and gives a mask. Entries of one id count
    once in a key. Groups of up to `block` ids are paired where their key is read; larger ones are only numbered
    there, and block_links compares them, so that no task gets a group's square. forest_only: stars by partition in
    place of all pairs.
    """
    sigs = [c for c in entries.columns if c not in ("key", "id")]

    def fold(a, b):
        if forest_only:
            return forest(a, b)
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        return low[new], high[new]

    def within(key, ids, sig):
        """Pairs within runs of equal key, offset by offset."""
        out_a, out_b = [], []
        at = np.arange(len(key))
        step, waiting = 1, 0
        while True:
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            hit = at[pairs(sig[at], sig[at + step])]
            out_a.append(ids[hit])
            out_b.append(ids[hit + step])
            waiting += len(hit)
            if forest_only and waiting > 1_000_000:  # dense groups have many more pairs than members
                a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b, waiting = [a], [b], 0
            step += 1
        if not out_a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_a), np.concatenate(out_b)

    names = ["a", "b", "key", "nth", "id", *sigs]

    def first(batches):
        kept: list[np.ndarray] = []
        running: dict[str, int] = {}  # the large group that goes on in the next batch: its key, rows numbered, last id

        def links(a, b):
            for i in range(0, len(a), 50_000):
                part = pa.array(a[i : i + 50_000])
                yield pa.record_batch([part, pa.array(b[i : i + 50_000]), *([pa.nulls(len(part), pa.int64())] * (3 + len(sigs)))], names=names)

        def numbered(rows, start):
            key, ids, sig = rows
            none = pa.nulls(len(key), pa.int64())
            return pa.record_batch([none, none, pa.array(key), pa.array(np.arange(start, start + len(key))), pa.array(ids), *(pa.array(np.ascontiguousarray(c)) for c in sig.T)], names=names)

        def closed(rows, more):
            """Rows in order of key and id; more: the last key goes on."""
            key, ids, sig = rows
            new = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]
            key, ids, sig = key[new], ids[new], sig[new]
            if running:
                end = np.searchsorted(key, running["key"], "right")
                begin = 1 if end and ids[0] == running["id"] else 0
                if end > begin:
                    yield numbered((key[begin:end], ids[begin:end], sig[begin:end]), running["n"])
                    running.update(n=running["n"] + int(end - begin), id=int(ids[end - 1]))
                key, ids, sig = key[end:], ids[end:], sig[end:]
                if len(key) or not more:
                    running.clear()
            if not len(key):
                return
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            alone = np.repeat(sizes, sizes)
            small = (alone > 1) & (alone <= block)
            yield from links(*fold(*within(key[small], ids[small], sig[small])))
            for start, n in zip(starts[sizes > block], sizes[sizes > block]):
                yield numbered((key[start : start + n], ids[start : start + n], sig[start : start + n]), 0)
            if more:
                running.update(key=int(key[-1]), n=int(sizes[-1]), id=int(ids[-1]))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "id"))
            sig = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in sigs], axis=1)
            kept = [np.concatenate(x) for x in zip(kept, (key, ids, sig))] if kept else [key, ids, sig]
            if len(kept[0]) <= 200_000:
                continue
            last = int(np.searchsorted(kept[0], kept[0][-1]))  # the last key may go on in the next batch
            if len(kept[0]) - last > block or running and running["key"] == kept[0][-1]:
                yield from closed(kept, True)
                kept = []
            else:
                yield from closed([x[:last] for x in kept], False)
                kept = [x[last:] for x in kept]
        if kept:
            yield from closed(kept, False)

    def compare(left, right, same):
        ids_a, ids_b = (x.column("id").to_numpy() for x in (left, right))
        sig_a, sig_b = (np.stack([x.column(c).to_numpy() for c in sigs], axis=1) for x in (left, right))
        out_a, out_b = [], []
        for i in range(len(ids_a)):
            rest = slice(i + 1, None) if same else slice(None)
            hit = pairs(np.broadcast_to(sig_a[i], sig_b[rest].shape), sig_b[rest])
            out_b.append(ids_b[rest][hit])
            out_a.append(np.full(len(out_b[-1]), ids_a[i]))
        return fold(np.concatenate(out_a), np.concatenate(out_b))

    ordered = entries.select("key", "id", *sigs).repartition("key").sortWithinPartitions("key", "id")
    found = durable(ordered.mapInArrow(first, ", ".join(f"{c} long" for c in names)))
    direct, large = found.where("a is not null").select("a", "b"), found.where("nth is not null").select("key", "nth", F.lit(0).cast("long").alias("by"), "id", *sigs)
    direct = direct.mapInArrow(stars, "a long, b long") if forest_only else direct
    return direct if large.isEmpty() else direct.unionByName(block_links(large, compare, block, fold=forest_only))
