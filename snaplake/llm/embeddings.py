"""Links between near-equal vectors, found in a robust-pruned flat graph.

Vectors are compared within their label. Equal vectors are one node. A label's nodes are cut into shards
around centres that are fitted on a bounded sample; every node belongs to the shards of its `overlap`
nearest centres. In each shard a flat proximity graph is built with robust pruning (Subramanya et al.,
2019), and a node's adjacency lists of all its shards are united. A shard is then searched, with the united
lists, from its medoid: greedily towards the query, then from everything found within the range outward
until no neighbour lies in it. Pairs found are verified by cosine in double precision. The audit
compares the links of a sample of nodes with brute force over their labels.

Shards have a bounded size. The first centres are `CENTRES` at most over all labels; a shard that comes out
with over four times its size is cut again around centres of its own, fitted on a sample of its nodes in the
cluster, and so on down, however many nodes there are. Only where a shard is dense, most of its nodes being
links of one another, is it cut by hash instead and its parts searched pairwise: its links then grow with the
square of its nodes, as counts of links need them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import connected_components, durable, tasks

#: Least cosine of a link.
COSINE = 0.93
#: Nodes of a shard on average, shards of each node, sampled vectors to fit centres, most centres.
SHARD, OVERLAP, SAMPLE, CENTRES = 600, 3, 20_000, 4_000
#: Shards cut again: centres of each at most, shards of each node, sampled nodes to fit them, part of the sample's pairs that link in a dense one, rounds.
FINER, FINER_OVERLAP, FINER_SAMPLE, DENSE, ROUNDS = 64, 2, 1_000, 0.05, 12
#: Robust pruning: neighbours of a node and the distance factor; width of the greedy search.
DEGREE, ALPHA, BEAM = 24, 1.2, 48


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(valid, unit vectors): null, empty and zero vectors and those with null or non-finite components aren't valid."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    out, valid = np.zeros((len(vectors), width)), np.zeros(len(vectors), bool)
    for k, v in enumerate(vectors):
        if v is not None and len(v) and None not in v:
            out[k, : len(v)] = v
            valid[k] = True
    valid &= np.isfinite(out).all(axis=1)
    out[~valid] = 0
    scale = np.abs(out).max(axis=1, initial=0)
    valid &= scale > 0
    out[valid] /= scale[valid, None]
    out[valid] /= np.sqrt((out[valid] ** 2).sum(axis=1))[:, None]
    return valid, out


def centres_of(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """n centres on the sphere, by a few rounds of k-means on the sample."""
    centre = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[i : i + 2000] @ centre.T, axis=1) for i in range(0, len(sample), 2000)])
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        norm = np.sqrt((total**2).sum(axis=1))
        live = norm > 1e-9
        centre[live] = total[live] / norm[live, None]
    return centre


def robust_prune(vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 64) -> list[np.ndarray]:
    """Adjacency of each vector: of its nearest ones, those that no chosen neighbour is closer to by the factor alpha; made mutual."""
    n = len(vectors)
    out: list[np.ndarray] = []
    pool = min(pool, n - 1)
    for low in range(0, n, 256):
        cosine = vectors[low : low + 256] @ vectors.T
        cosine[np.arange(len(cosine)), np.arange(low, low + len(cosine))] = -2
        near = np.argpartition(-cosine, pool - 1, axis=1)[:, :pool] if pool > 0 else np.empty((len(cosine), 0), int)
        for row in range(len(cosine)):
            order = near[row][np.argsort(-cosine[row, near[row]], kind="stable")]
            far = 1 - cosine[row, order]
            between = 1 - vectors[order] @ vectors[order].T
            live, chosen = np.ones(len(order), bool), []
            for k in range(len(order)):
                if live[k]:
                    chosen.append(k)
                    if len(chosen) >= degree:
                        break
                    live &= alpha**2 * between[k] > far
            out.append(order[chosen])
    back: list[list[int]] = [list(x) for x in out]
    for a, row in enumerate(out):
        for b in row:
            back[b].append(a)
    return [np.unique(np.array(x, np.int64)) for x in back]


def search(vectors: np.ndarray, graph: list[np.ndarray], start: int, query: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """Nodes with cosine >= least: greedy search from start, then outward from all that is in range."""
    seen = np.zeros(len(vectors), bool)
    seen[start] = True
    found = np.array([start])
    score = vectors[found] @ query
    done = np.zeros(1, bool)
    while True:
        top = np.argsort(-score, kind="stable")[:beam]
        open_ = top[~done[top]]
        if not len(open_):
            break
        now = open_[:4]
        done[now] = True
        fresh = np.unique(np.concatenate([graph[found[k]] for k in now]))
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        found = np.concatenate([found, fresh])
        score = np.concatenate([score, vectors[fresh] @ query])
        done = np.concatenate([done, np.zeros(len(fresh), bool)])
    slack = least - 1e-6
    inside = found[score >= slack]
    edge = inside
    while len(edge):  # range expansion
        fresh = np.unique(np.concatenate([graph[k] for k in edge]))
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        edge = fresh[vectors[fresh] @ query >= slack]
        inside = np.concatenate([inside, edge])
    return inside


def _bytes(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix, np.float64)], pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def nodes_of(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, unit: binary or null) of all rows."""

    def scan(batches):
        for batch in batches:
            valid, out = unit(batch.column(2).to_pylist())
            blob = pa.array([row.tobytes() if ok else None for ok, row in zip(valid, out + 0.0)], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), blob], names=["vec_id", "label", "unit"])

    chosen = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return chosen.mapInArrow(scan, "vec_id long, label string, unit binary")


def _by_key(work, names: list[str]):
    """For mapInArrow: work(batch) of all rows that agree in the columns names; they come one after the other."""

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in names)))
            start = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    if keys[start] != key and held:
                        yield from work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                        held = []
                    key = keys[start]
                    held.append(batch.slice(start, k - start))
                    start = k
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def first_shards(nodes: DataFrame, shard: int, overlap: int, most: int) -> DataFrame:
    """(node, label, place: string, home, unit): a row for each shard of a node; home: its nearest one."""
    spark = nodes.sparkSession
    counts = nodes.groupBy("label").count()
    total = nodes.count()
    part = min(1.0, SAMPLE / max(1, total))
    # what the driver gets is bounded by SAMPLE vectors, of each label in proportion
    taken = nodes.where((F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1_000_000)) < int(part * 1_000_000) + 1)).limit(2 * SAMPLE).toPandas()
    sizes = {r["label"]: r["count"] for r in counts.orderBy(F.desc("count"), "label").limit(most).collect()}
    centres, left = {}, most
    for label, rows in taken.groupby("label"):
        n = min(left, max(1, round(sizes.get(label, 0) / shard)), len(rows))
        if n > 1:
            found = np.stack([np.frombuffer(x, np.float64) for x in rows.sort_values("node")["unit"]])
            centres[label], left = centres_of(found, n), left - n
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, vectors = np.array(batch.column("label").to_pylist(), object), _matrix(batch.column("unit"))
            node, place, home = [], [], []
            for label in set(labels.tolist()):
                rows = np.flatnonzero(labels == label)
                centre = shared.value.get(label)
                near = np.zeros((len(rows), 1), int) if centre is None else np.argsort(-(vectors[rows] @ centre.T), axis=1, kind="stable")[:, :overlap]
                for k in range(near.shape[1]):
                    node.append(rows)
                    place.append(near[:, k])
                    home.append(np.full(len(rows), k == 0))
            rows = np.concatenate(node)
            take = pa.array(rows)
            places = pa.array([str(x) for x in np.concatenate(place).tolist()])
            yield pa.record_batch([batch.column("node").take(take), batch.column("label").take(take), places, pa.array(np.concatenate(home)), batch.column("unit").take(take)], names=["node", "label", "place", "home", "unit"])

    return nodes.select("node", "label", "unit").mapInArrow(assign, "node long, label string, place string, home boolean, unit binary")


def finer_shards(members: DataFrame, crowded: DataFrame, shard: int, least: float) -> DataFrame:
    """The members of crowded shards (label, place, n) in smaller ones, or in the same if that is dense (parts > 1).

    Centres are fitted on a sample of each shard's nodes by one task a shard, and dealt out to as many tasks as
    read its nodes.
    """
    own = members.join(crowded, ["label", "place"])
    sampled = own.where(F.pmod(F.xxhash64("node", F.lit(5)), F.col("n")) < FINER_SAMPLE)

    def fit(batch):
        vectors, n = _matrix(batch.column("unit")), batch.column("n")[0].as_py()
        cosine = vectors @ vectors.T
        dense = (np.count_nonzero(cosine >= least) - len(vectors)) > DENSE * max(1, len(vectors) * (len(vectors) - 1))
        k = 1 if dense else max(2, min(FINER, -(-n // shard), len(vectors)))
        yield pa.record_batch([batch.column("label").slice(0, 1), batch.column("place").slice(0, 1), pa.array([n], pa.int64()), pa.array([None if k == 1 else centres_of(vectors, k).tobytes()], pa.binary())], names=["label", "place", "n", "centres"])

    ordered = sampled.select("label", "place", "n", "node", "unit").repartition(tasks(members), "label", "place").sortWithinPartitions("label", "place", "node")
    fitted = durable(ordered.mapInArrow(_by_key(fit, ["label", "place"]), "label string, place string, n long, centres binary"))
    salts = F.ceil(F.col("n") / 50_000).cast("int")
    copies = fitted.select("label", "place", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "centres", F.lit(None).cast("long").alias("node"), F.lit(None).cast("boolean").alias("home"), F.lit(None).cast("binary").alias("unit"))
    dealt = own.select("label", "place", F.pmod(F.xxhash64("node", F.lit(6)), salts).cast("int").alias("salt"), F.lit(None).cast("binary").alias("centres"), "node", "home", "unit")

    def assign(batches):
        key, centre = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "place", "salt"))))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                part = batch.slice(low, high - low)
                if keys[low] != key:
                    key, blob = keys[low], part.column("centres")[0].as_py()
                    part = part.slice(1)
                    centre = None if blob is None else blob
                if not part.num_rows:
                    continue
                vectors = _matrix(part.column("unit"))
                if centre is None:
                    rows, sub, nearest = np.arange(len(vectors)), [key[1] + "|"] * len(vectors), np.ones(len(vectors), bool)
                else:
                    near = np.argsort(-(vectors @ np.frombuffer(centre, np.float64).reshape(-1, vectors.shape[1]).T), axis=1, kind="stable")[:, :FINER_OVERLAP]
                    rows = np.repeat(np.arange(len(vectors)), near.shape[1])
                    sub = [f"{key[1]}.{x}" for x in near.ravel().tolist()]
                    nearest = np.tile(np.arange(near.shape[1]) == 0, len(vectors))
                take = pa.array(rows)
                home = part.column("home").to_numpy(zero_copy_only=False).astype(bool)[rows] & nearest
                yield pa.record_batch([part.column("node").take(take), part.column("label").take(take), pa.array(sub), pa.array(home), part.column("unit").take(take)], names=["node", "label", "place", "home", "unit"])

    keyed = ["label", "place", "salt"]
    work = copies.unionByName(dealt).repartition(tasks(members), *keyed).sortWithinPartitions(*keyed, F.col("node").asc_nulls_first())
    return work.mapInArrow(assign, "node long, label string, place string, home boolean, unit binary")


def shards_of(nodes: DataFrame, least: float, shard: int, overlap: int, most: int) -> DataFrame:
    """(node, label, place, home, unit, part, parts): dense shards, whose places end in |, have several parts, others one."""
    members = durable(first_shards(nodes, shard, overlap, most))
    done = []
    for _ in range(ROUNDS):
        sized = members.groupBy("label", "place").agg(F.count("*").alias("n"))
        crowded = durable(sized.where((F.col("n") > 4 * shard) & ~F.col("place").endswith("|")))
        if crowded.isEmpty():
            break
        done.append(members.join(crowded.drop("n"), ["label", "place"], "left_anti"))
        members = durable(finer_shards(members, crowded, shard, least))
        # a node may come into one shard by two ways
        members = members.groupBy("node", "label", "place").agg(F.max("home").alias("home"), F.min("unit").alias("unit"))
    for more in done:
        members = members.unionByName(more)
    crowd = members.groupBy("label", "place").agg(F.ceil(F.count("*") / (4 * shard)).cast("int").alias("parts"))
    return durable(members.join(crowd, ["label", "place"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))


def vector_links(nodes: DataFrame, least: float = COSINE, shard: int = SHARD, overlap: int = OVERLAP, most: int = CENTRES) -> DataFrame:
    """Links (a < b: node) of nodes (node long, label string, unit binary), each pair once."""
    members = shards_of(nodes, least, shard, overlap, most)

    def build(batch):
        vectors, ids = _matrix(batch.column("unit")), batch.column("node").to_numpy()
        graph = robust_prune(vectors)
        a = np.repeat(np.arange(len(ids)), [len(x) for x in graph])
        b = np.concatenate(graph) if graph else np.empty(0, np.int64)
        for i in range(0, len(a), 50_000):
            yield pa.record_batch([pa.array(ids[a[i : i + 50_000]]), pa.array(ids[b[i : i + 50_000]])], names=["node", "next"])

    keys = ["label", "place", "part"]
    sharded = members.repartition(tasks(nodes), *keys).sortWithinPartitions(*keys, "node")
    edges = sharded.mapInArrow(_by_key(build, keys), "node long, next long")
    united = edges.groupBy("node").agg(F.sort_array(F.collect_set("next")).alias("next"))
    # every part of a dense shard meets every home part: one copy of the part's nodes for each
    asked = members.withColumn("asks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(united, "node", "left")
    inside = asked.select(*keys, "asks", "node", "unit", "next", (F.col("home") & (F.col("asks") == F.col("part"))).alias("query"), F.lit(True).alias("member"))
    into = members.where("home and parts > 1").withColumn("into", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("into <> part")
    guests = into.select("label", "place", F.col("into").alias("part"), F.col("part").alias("asks"), "node", "unit", F.lit(None).cast("array<long>").alias("next"), F.lit(True).alias("query"), F.lit(False).alias("member"))

    def probe(batch):
        member = batch.column("member").to_numpy(zero_copy_only=False)
        query = batch.column("query").to_numpy(zero_copy_only=False)
        ids, vectors, lists = batch.column("node").to_numpy(), _matrix(batch.column("unit")), batch.column("next").to_pylist()
        inside = np.flatnonzero(member)
        if not len(inside) or not query.any():
            return
        place = {int(ids[r]): k for k, r in enumerate(inside)}
        graph = [np.array([place[x] for x in lists[r] or () if x in place], np.int64) for r in inside]
        local = vectors[inside]
        graph = _joined(local, graph)
        start = int(np.argmax(local @ local.sum(axis=0)))
        out_a, out_b = [], []
        for r in np.flatnonzero(query):
            hit = search(local, graph, start, vectors[r], least)
            hit = hit[(local[hit] * vectors[r]).sum(axis=1) >= least]
            out_b.append(ids[inside[hit]])
            out_a.append(np.full(len(hit), ids[r]))
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        low, high = np.minimum(a, b), np.maximum(a, b)
        keep = low < high
        pairs = np.unique(np.stack([low[keep], high[keep]], axis=1), axis=0)
        for i in range(0, len(pairs), 50_000):
            yield pa.record_batch([pa.array(pairs[i : i + 50_000, 0]), pa.array(pairs[i : i + 50_000, 1])], names=["a", "b"])

    keys = [*keys, "asks"]
    work = inside.unionByName(guests).repartition(tasks(nodes), *keys).sortWithinPartitions(*keys, "node", "member")
    return work.mapInArrow(_by_key(probe, keys), "a long, b long").distinct()


def _joined(vectors: np.ndarray, graph: list[np.ndarray]) -> list[np.ndarray]:
    """graph with a link from the medoid to one node of each part that can't be reached from it, so that every node can."""
    n = len(graph)
    start = int(np.argmax(vectors @ vectors.sum(axis=0)))
    seen = np.zeros(n, bool)

    def reach(k):
        edge = np.array([k])
        seen[k] = True
        while len(edge):
            fresh = np.unique(np.concatenate([graph[x] for x in edge]))
            edge = fresh[~seen[fresh]]
            seen[edge] = True

    reach(start)
    more = []
    while not seen.all():
        k = int(np.argmin(seen))
        more.append(k)
        reach(k)
    graph[start] = np.unique(np.concatenate([graph[start], np.array(more, np.int64)]))
    return graph


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = COSINE, shard: int = SHARD, overlap: int = OVERLAP, most: int = CENTRES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row with an id.

    Vectors of one label that isn't null link if their cosine is `least` or more. Null vectors, zero vectors
    and those with null or non-finite components link with nothing; vectors of other lengths count as if
    filled with zeros. Rows that repeat an id count once, with one of their vectors (the least); rows without
    an id are left out; other columns don't matter. No rows: no rows.
    """
    every = nodes_of(rows, id_col, vector_col, label_col).where("vec_id is not null")
    every = durable(every.groupBy("vec_id").agg(F.min(F.struct("label", "unit")).alias("v")).select("vec_id", "v.label", "v.unit"))
    width = every.agg(F.max(F.octet_length("unit"))).first()[0] or 8
    padded = F.when(F.octet_length("unit") < width, F.concat("unit", F.unhex(F.repeat(F.lit("00"), F.lit(width) - F.octet_length("unit"))))).otherwise(F.col("unit"))
    every = every.withColumn("unit", padded)
    alike = durable(every.where("unit is not null and label is not null").groupBy("label", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    links = durable(vector_links(alike, least, shard, overlap, most))
    sized = alike.select("node", "n")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = both.join(sized, F.col("b") == F.col("node")).groupBy("a").agg(F.sum("n").alias("others"))
    classes = connected_components(links)
    facts = alike.join(partners, F.col("node") == F.col("a"), "left").join(classes, F.col("node") == F.col("id"), "left")
    facts = facts.select("label", "unit", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = every.join(facts, ["label", "unit"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def audit(rows: DataFrame, links: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = COSINE, every_nth: int = 50, block: int = 2_000) -> DataFrame:
    """(found, there, recall): links with partners of the vectors whose id every_nth divides, against all vectors of their labels.

    links: near_vectors' result. Vectors and queries are packed in blocks of about `block` by label, and blocks
    of one label are compared by one task each; nothing passes through the driver. Ids are taken as unique.
    """
    nodes = durable(nodes_of(rows, id_col, vector_col, label_col).where("unit is not null and label is not null and vec_id is not null"))

    def blocks(chosen: DataFrame, name: str) -> DataFrame:
        parts = chosen.groupBy("label").agg(F.ceil(F.count("*") / block).alias("parts"))
        numbered = chosen.join(parts, "label").withColumn("number", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
        return numbered.groupBy("label", "number").agg(F.collect_list(F.struct("vec_id", "unit")).alias(name)).drop("number")

    asked = nodes.where(f"vec_id % {int(every_nth)} = 0")
    couples = blocks(asked, "queries").join(blocks(nodes, "others"), "label").select("queries", "others")

    def compare(batches):
        for batch in batches:
            for queries, others in zip(batch.column("queries").to_pylist(), batch.column("others").to_pylist()):
                left, right = (np.stack([np.frombuffer(x["unit"], np.float64) for x in side]) for side in (queries, others))
                mine, theirs = (np.array([x["vec_id"] for x in side]) for side in (queries, others))
                hit = (left @ right.T >= least) & (mine[:, None] != theirs[None, :])
                yield pa.record_batch([pa.array(mine), pa.array(hit.sum(axis=1))], names=["vec_id", "n"])

    there = couples.repartition(nodes.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(compare, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("there"))
    both = there.join(links.select("vec_id", "n_links"), "vec_id")
    sums = both.agg(F.coalesce(F.sum("n_links"), F.lit(0)).alias("found"), F.coalesce(F.sum("there"), F.lit(0)).alias("there"))
    return sums.withColumn("recall", F.when(F.col("there") > 0, F.col("found") / F.col("there")).otherwise(1.0))
