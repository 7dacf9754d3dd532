"""A stored inverted index for keyword search: postings in blocks by term, read for a query's terms only.

Postings are gathered into runs by field and term, which are range-partitioned by field, term and first id and cut
into blocks of some hundred, so that a frequent term lies in many files and a rare one in a page of one. A block has
its ids, which rise, as gaps, counts, lengths, and the most that
any of its postings can add to a score, without the term's weight. Scores are those of search.bm25. For the k best,
blocks that can't lift a document over the k-th best score known are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.operators.filters import _words, tokens
from snaplake.operators.search import K1, B, top

#: Postings of a block; blocks that are looked up by name.
BLOCK, NAMED = 128, 2_000
#: Words of the documents that a run is made of, and postings of a row of it at most.
WORDS, RUN = 1_000_000, 256
_RUNS = "field string, term string, first long, n long, words long, postings binary"
#: A posting in a run: document, occurrences, words of the document.
_POSTING = np.dtype([("id", "<i8"), ("tf", "<i4"), ("len", "<i4")])
_PAGES = {"parquet.block.size": 8_000_000, "parquet.page.row.count.limit": 200}
_SCHEMA = "field string, term string, first long, last long, n int, best double, gaps array<long>, counts array<int>, lengths array<int>"


def _part(tf, length, mean):
    """What a posting adds, but for the term's weight; of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _lists(offsets, values, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _runs(batches):
    """Postings of some documents at a time, by field and term, and a row of the empty term with their number and words (in n and words)."""
    for batch in batches:
        at, ends = 0, batch.column("w").offsets.to_numpy()
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS, "right")) - 1)
            part, at = batch.slice(at, stop - at), stop
            named = pc.dictionary_encode(part.column("f"))
            fields, field_of = named.dictionary, named.indices.to_numpy()
            lengths = pc.list_value_length(part.column("w")).to_numpy().astype(np.int64)
            found = pc.dictionary_encode(part.column("w").flatten())
            order = pc.sort_indices(found.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            doc = np.repeat(np.arange(part.num_rows), lengths)
            # one number for field, term and document, so that a sort counts them
            key, tf = np.unique((np.repeat(field_of, lengths) * len(order) + rank[found.indices.to_numpy()]) * part.num_rows + doc, return_counts=True)
            group, doc = key // part.num_rows, key % part.num_rows
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            cut = np.flatnonzero(place % RUN == 0)
            postings = np.empty(len(group), _POSTING)
            postings["id"], postings["tf"], postings["len"] = part.column("id").to_numpy()[doc], tf, lengths[doc]
            offsets, n = np.r_[cut, len(group)], len(fields)
            docs, words = np.bincount(field_of, minlength=n), np.bincount(field_of, lengths, n).astype(np.int64)
            here, term = np.divmod(group[cut], max(1, len(order)))
            terms = found.dictionary.take(pa.array(order[term]))
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(cut) + n, [None, pa.py_buffer(np.r_[offsets, np.full(n, len(group))].astype(np.int32) * _POSTING.itemsize), pa.py_buffer(postings)])
            yield pa.record_batch(
                [
                    pa.concat_arrays([fields.take(pa.array(here)), fields]), pa.concat_arrays([terms, pa.array([""] * n)]), pa.array(np.r_[postings["id"][cut], np.zeros(n, np.int64)]),
                    pa.array(np.r_[np.diff(offsets), docs], pa.int64()), pa.array(np.r_[np.zeros(len(cut), np.int64), words], pa.int64()), packed,
                ],
                names=["field", "term", "first", "n", "words", "postings"],
            )


def _blocks(means: dict[str, float], size: int):
    """Blocks of runs that come in order; what a term has left over waits for its next run."""

    def told(fields, terms, sizes, ids, tf, n, last: bool):
        """Blocks of these runs, and of the last term what may still grow: its field, term, ids, counts, lengths."""
        same = np.r_[False, (pc.equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)) & (pc.equal(fields[1:], fields[:-1]).to_numpy(zero_copy_only=False))]
        run_of = np.flatnonzero(~same)  # first run of each term
        total = np.add.reduceat(sizes, run_of)
        start = np.cumsum(total) - total
        by_id = np.lexsort((ids, np.repeat(np.arange(len(total)), total)))
        ids, tf, n = ids[by_id], tf[by_id], n[by_id]
        end = len(ids) if last else len(ids) - int(total[-1] % size)
        held = None if last else (fields[-1:], terms[-1:], ids[end:], tf[end:], n[end:])
        cut = np.flatnonzero((np.arange(len(ids)) - np.repeat(start, total)) % size == 0)
        cut = cut[cut < end]
        if not len(cut):
            return None, held
        term_of = run_of[np.searchsorted(start, cut, "right") - 1]
        offsets = np.r_[cut, end]
        fields, terms = fields.take(pa.array(term_of)), terms.take(pa.array(term_of))
        named = pc.dictionary_encode(fields)
        mean = np.repeat(np.array([means[f] or 1.0 for f in named.dictionary.to_pylist()])[named.indices.to_numpy()], np.diff(offsets))
        best = np.maximum.reduceat(_part(tf[:end].astype(float), n[:end].astype(float), mean), cut)
        gaps = np.diff(ids[:end], prepend=ids[:1])
        gaps[cut] = 0
        columns = [fields, terms, pa.array(ids[cut]), pa.array(ids[offsets[1:] - 1]), pa.array(np.diff(offsets), pa.int32()), pa.array(best), _lists(offsets, gaps, pa.int64()), _lists(offsets, tf[:end], pa.int32()), _lists(offsets, n[:end], pa.int32())]
        return pa.record_batch(columns, names=["field", "term", "first", "last", "n", "best", "gaps", "counts", "lengths"]), held

    def run(batches):
        held = None
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                fields, terms = batch.column("field"), batch.column("term")
                packed = batch.column("postings")
                sizes = pc.binary_length(packed).to_numpy().astype(np.int64) // _POSTING.itemsize
                rows = np.frombuffer(b"".join(packed.to_pylist()), _POSTING)
                postings = [rows[c] for c in ("id", "tf", "len")]
                if held:
                    fields, terms, sizes = pa.concat_arrays([held[0], fields]), pa.concat_arrays([held[1], terms]), np.r_[len(held[2]), sizes]
                    postings = [np.concatenate(x) for x in zip(held[2:], postings)]
                out, held = told(fields, terms, sizes, *postings, False)
                if out is not None:
                    yield out
        if held and len(held[2]):
            yield told(held[0], held[1], np.array([len(held[2])]), *held[2:], True)[0]

    return run


def build(docs: DataFrame, id_col: str, fields: list[str], folder: str, block: int = BLOCK) -> None:
    """Writes the index of text columns, in place of one that is there. Ids are whole numbers, each once; rows without id are left out, null texts count as empty.

    Documents are read once: their postings go to the folder as runs, some thousand documents each, and runs are put
    in order, not single postings. The runs stay there; searches don't read them.
    """
    spark = docs.sparkSession
    named = [F.struct(F.lit(f).alias("f"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("w")) for f in fields]
    cut = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(F.array(*named)).alias("f")).select("id", "f.f", "f.w")
    cut.mapInArrow(_runs, _RUNS).write.mode("overwrite").parquet(f"{folder}/runs")
    runs = spark.read.schema(_RUNS).parquet(f"{folder}/runs")
    stats = runs.where("term = ''").groupBy("field").agg(F.sum("n").alias("n_docs"), (F.sum("words") / F.sum("n")).alias("mean_len"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    means = {r.field: r.mean_len for r in spark.read.parquet(f"{folder}/stats").collect()}  # a row a field
    order = ["field", "term", "first"]
    blocks = runs.where("term <> ''").repartitionByRange(*order).sortWithinPartitions(*order).select("field", "term", "postings").mapInArrow(_blocks(means, block), _SCHEMA)
    blocks.write.mode("overwrite").options(**_PAGES).parquet(f"{folder}/blocks")


def _decoded(blocks: DataFrame) -> DataFrame:
    """field, term, id, tf, len of every posting."""

    def run(batches):
        for batch in batches:
            sizes = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(sizes):
                continue
            gaps = batch.column("gaps").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            gaps[starts] = 0
            run_up = np.cumsum(gaps)
            ids = run_up - np.repeat(run_up[starts], sizes) + np.repeat(batch.column("first").to_numpy(zero_copy_only=False), sizes)
            take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.record_batch([batch.column("field").take(take), batch.column("term").take(take), pa.array(ids), batch.column("counts").flatten(), batch.column("lengths").flatten()], names=["field", "term", "id", "tf", "len"])

    return blocks.select("field", "term", "first", "n", "gaps", "counts", "lengths").mapInArrow(run, "field string, term string, id long, tf int, len int")


def search(spark: SparkSession, folder: str, query: str, fields: list[str] | None = None, last_as_prefix: bool = False, k: int | None = None) -> DataFrame:
    """(id, score) of the documents with one of the query's words in one of the fields (None: all), a sum over fields; k: the k best only, ties by id.

    Scores equal search.bm25's over each field. A query without words gives no rows.
    """
    words = list(dict.fromkeys(_words(query)))
    exact, prefix = (words[:-1], words[-1:]) if last_as_prefix else (words, [])
    stats = {r.field: (r.n_docs, r.mean_len) for r in spark.read.parquet(f"{folder}/stats").collect() if fields is None or r.field in fields}
    hit = F.col("term").isin(exact) if exact or not prefix else F.lit(False)
    if prefix:
        hit = hit | F.col("term").startswith(prefix[0])
    blocks = spark.read.schema(_SCHEMA).parquet(f"{folder}/blocks").where(F.col("field").isin(list(stats))).where(hit)
    known = spark.createDataFrame([(f, int(n), float(m or 0.0)) for f, (n, m) in stats.items()], "field string, n_docs long, mean_len double")
    df = blocks.groupBy("field", "term").agg(F.sum("n").alias("df"), F.max("best").alias("most")).join(F.broadcast(known), "field")
    weights = df.withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    def scored(chosen: DataFrame) -> DataFrame:
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
        return _decoded(chosen).join(weights, ["field", "term"]).groupBy("id").agg(F.round(F.sum(part), 12).alias("score"))

    if k is None:
        return scored(blocks)
    return top(scored(_worth_reading(blocks, weights, scored, k)), k)


def _worth_reading(blocks: DataFrame, weights: DataFrame, scored, k: int) -> DataFrame:
    """The blocks that can hold a posting of one of the k best: their most, with the most of all other terms, reaches the k-th best score of a few blocks."""
    facts = blocks.select("field", "term", "first", "best").join(weights.select("field", "term", "idf", "most"), ["field", "term"]).withColumn("upper", F.col("best") * F.col("idf"))
    first = facts.orderBy(F.desc("upper"), "field", "term", "first").limit(k).select("field", "term", "first").collect()
    if len(first) < k:
        return blocks
    lower = [r.score for r in top(scored(_named(blocks, first)), k).collect()]
    if len(lower) < k:
        return blocks
    others = weights.agg(F.sum(F.col("most") * F.col("idf"))).first()[0]
    reach = F.col("upper") + F.lit(others) - F.col("most") * F.col("idf")
    kept = facts.where(reach >= lower[-1] - 1e-9).select("field", "term", "first")
    listed = kept.limit(NAMED + 1).collect()
    return _named(blocks, listed) if len(listed) <= NAMED else blocks.join(kept, ["field", "term", "first"], "left_semi")


def _named(blocks: DataFrame, rows) -> DataFrame:
    """The blocks of these fields, terms and first ids; the filter reaches the files' pages."""
    by: dict[tuple, list[int]] = {}
    for r in rows:
        by.setdefault((r.field, r.term), []).append(r.first)
    terms = [(F.col("field") == f) & (F.col("term") == t) & F.col("first").isin(sorted(x)) for (f, t), x in by.items()]
    while len(terms) > 1:
        terms = [terms[i] | terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return blocks.where(terms[0]) if terms else blocks.limit(0)
