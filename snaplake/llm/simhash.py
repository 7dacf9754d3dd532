"""SimHash near-duplicates, found with fuzzy keys from the perfect binary Golay code.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in at
most two bits agree wholly in one segment at least (pigeonhole), and the next segment holds at most both
errors. The (23,12,7) Golay code is perfect: every word of 23 bits lies within distance 3 of exactly one
codeword. Decoding a segment and its one-bit neighbours gives one to six codeword indices, and two
segments at distance two or less share one, as some word lies within one bit of both. So a key is
(which segment, its exact bits, one codeword index of the next segment): 18 keys a fingerprint at most,
and no link is lost. Fingerprints that share a key are compared bit by bit.

Near copies, as a pipeline removes them, share four fifths of their five-word shingles and differ in more bits
than that. They get a smoother fingerprint, of a text's different words, and a radius of five bits: two of the
three segments hold at most two errors each then, so a key is (which two segments, a codeword index of either),
108 at most. Most pairs that differ in more bits share a key as well: three errors or more in two segments are
rare up to nine bits. So what shares a key is let through up to twelve bits, if a second fingerprint, of the
shingles, agrees, and then verified by its exact shingles.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import block_links, bucket_pairs, connected_components, durable, forest, free_names
from snaplake.llm.decontaminate import Hashes, tokens_of, unique_shingles

#: Fixed value: generator polynomial of the (23,12,7) Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011
#: (lowest bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 2
#: Near copies: bits of the words' fingerprint within which no pair is missed, bits of it and of the shingles' that may differ, words in a shingle, least shared part (Jaccard).
NEAR_BITS, WORD_BITS, SHINGLE_BITS, SHINGLE, NEAR = 5, 12, 18, 5, 0.8
#: Texts that one task verifies against one another; larger groups go in pairs of such blocks. Keys of rows that are broadcast at most (some 25 MB).
BLOCK, BROADCAST_ROWS = 256, 1_000_000
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _remainder(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _error_table() -> np.ndarray:
    """The error pattern of weight up to 3 for each of the 2,048 remainders."""
    one = 1 << np.arange(23, dtype=np.int64)
    patterns = {0}
    for _ in range(3):
        patterns |= {int(p | b) for p in patterns for b in one}
    patterns = np.array(sorted(patterns), np.int64)
    errors = np.zeros(2048, np.int64)
    errors[_remainder(patterns)] = patterns
    return errors


_ERRORS = _error_table()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword next to each word of 23 bits."""
    return (words ^ _ERRORS[_remainder(words)]) >> 11


def fuzzy_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits + 1) indices: of each word and of its one-bit neighbours. Repeats occur."""
    flips = np.concatenate([np.zeros(1, np.int64), 1 << np.arange(bits, dtype=np.int64)])
    return codeword_index(words[:, None] ^ flips[None, :])


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of each fingerprint (uint64)."""
    parts = [((fingerprints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    rows, keys = [], []
    for k, exact in enumerate(parts):
        following = (k + 1) % 3
        index = np.sort(fuzzy_indices(parts[following], SEGMENTS[following][1]), axis=1)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        row, column = np.nonzero(new)
        rows.append(row)
        keys.append((np.int64(k) << 40) | (exact[row] << 12) | index[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def pair_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) with a key for every two segments and an index of either. Fingerprints within five bits share a key."""
    near = []
    for low, bits in SEGMENTS:
        index = np.sort(fuzzy_indices(((fingerprints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64), bits), axis=1)
        index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
        index = -np.sort(-index, axis=1)
        near.append(index[:, : max(1, int((index >= 0).sum(axis=1).max(initial=0)))])
    rows, keys = [], []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        left, right = near[i][:, :, None], near[j][:, None, :]
        both = (left >= 0) & (right >= 0)
        rows.append(np.nonzero(both)[0])
        keys.append(((np.int64(k) << 24) | (left << 12) | right)[both])
    return np.concatenate(rows), np.concatenate(keys)


def majority(hashes: np.ndarray) -> int:
    """SimHash of 64-bit hashes of equal weight: a bit is 1 if set in over half of them; 0 of none."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[start : start + 65_536], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the text's shingles of `words` words (repeats count), A-Z lower-cased; 0 without words."""
    tokens = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones, total = np.zeros(64, np.int64), n
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, 65_536):
        stop = min(n, start + 65_536)
        hashed = np.fromiter((digest(b" ".join(tokens[i : i + words]), seed) for i in range(start, stop)), np.uint64, stop - start)
        ones += np.unpackbits(hashed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""

    def scan(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, fp long")


def _within(bits: int):
    return lambda left, right: np.bitwise_count((left[:, 0] ^ right[:, 0]).view(np.uint64)) <= bits


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 hex digits. component_id: the smallest doc_id reachable by links, where fingerprints
    that differ in two bits or fewer link. Null, empty and blank texts have fingerprint zero and link like
    any other; rows that repeat a doc_id each get a row; a null doc_id stays null and, if its fingerprint
    occurs with an id, takes part in that component; further columns of docs don't matter. No rows: no rows.
    """
    prints = durable(fingerprints(docs, id_col, text_col, words))
    alike = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))

    def keyed(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            row, key = golay_keys(fp.view(np.uint64))
            yield pa.record_batch([pa.array(key), pa.array(batch.column("first").to_numpy(zero_copy_only=False)[row]), pa.array(fp[row])], names=["key", "id", "sig"])

    entries = alike.where("first is not null").select("fp", "first").mapInArrow(keyed, "key long, id long, sig long")
    classes = connected_components(bucket_pairs(entries, _within(MAX_BITS), forest_only=True), folded=True)
    moved = alike.join(classes, F.col("first") == F.col("id"), "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    moved = durable(moved)
    return prints.join(moved, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_prints(rows: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(k1, k2, h1, h2, fp, sig) of rows (k1, k2, text): a 128-bit hash of the lower-cased words in order, the SimHash of the different words and that of the different shingles."""

    def scan(batches):
        seen = Hashes()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                tokens = tokens_of(text)
                whole = xxhash.xxh3_128_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass"))
                hashed = np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
                out.append((whole >> 64, whole & ((1 << 64) - 1), majority(np.unique(hashed)), majority(unique_shingles(hashed, words))))
            cols = [pa.array(c.view(np.int64)) for c in np.array(out, np.uint64).reshape(-1, 4).T.copy()]
            yield pa.record_batch([batch.column("k1"), batch.column("k2"), *cols], names=["k1", "k2", "h1", "h2", "fp", "sig"])

    return rows.select("k1", "k2", "text").mapInArrow(scan, "k1 struct<without: boolean, id: long>, k2 long, h1 long, h2 long, fp long, sig long")


def _alike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether (fp, sig) may be near copies."""
    near = np.bitwise_count((left ^ right).view(np.uint64))
    return (near[:, 0] <= WORD_BITS) & (near[:, 1] <= SHINGLE_BITS)


def jaccard_links(words: int, least: float):
    """compare() for block_links: a forest of the pairs of texts (id, fp, sig, text) that may be near copies and share `least` of their shingles.

    From each text the search goes on among what no search has reached, so that in a dense group every text is
    verified about once; the components are those of all links.
    """

    def compare(left, right, same):
        seen = Hashes()
        parts = [left] if same else [left, right]
        ids, sig = (np.concatenate([f(x) for x in parts]) for f in (lambda x: x.column("id").to_numpy(), lambda x: np.stack([x.column(c).to_numpy() for c in ("fp", "sig")], axis=1)))
        texts = [t for x in parts for t in x.column("text").to_pylist()]
        side = np.repeat(np.arange(len(parts)), [x.num_rows for x in parts])
        sets: dict[int, np.ndarray] = {}

        def shingles(k):
            if k not in sets:
                tokens = tokens_of(texts[k])
                sets[k] = unique_shingles(np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens)), words)
            return sets[k]

        waiting = np.ones(len(ids), bool)
        found_a, found_b = [], []
        for root in range(len(ids)):
            if not waiting[root]:
                continue
            waiting[root] = False
            edge = [root]
            while edge:
                x = edge.pop()
                near = np.flatnonzero(waiting if same else waiting & (side != side[x]))
                own = shingles(x)
                for y in near[_alike(np.broadcast_to(sig[x], (len(near), 2)), sig[near])].tolist():
                    other = shingles(y)
                    if min(len(own), len(other)) < least * max(len(own), len(other)) - 1e-9:
                        continue
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    if shared >= least * (len(own) + len(other) - shared) - 1e-9:
                        found_a.append(x)
                        found_b.append(y)
                        waiting[y] = False
                        edge.append(y)
        return forest(ids[found_a], ids[found_b]) if found_a else (np.empty(0, np.int64), np.empty(0, np.int64))

    return compare


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, least: float = NEAR, block: int = BLOCK) -> DataFrame:
    """(k1, k2, first): for every different (id, text) of docs, whether it is the first of its group, by id (null ids last) and hash of the text.

    Texts with the same words in the same order are one; others link if their fingerprints of words share a key
    (all within NEAR_BITS do) and differ in WORD_BITS bits or fewer, those of shingles in SHINGLE_BITS or fewer,
    and they share `least` of their different shingles. A group is what links reach. Texts without words are one group.
    """
    keyed = docs.select(*near_key(docs, id_col, text_col), F.col(text_col).alias("text"))
    prints = durable(text_prints(keyed, words))
    here = F.struct("k1", "k2")
    nodes = durable(prints.groupBy("h1", "h2").agg(F.min(here).alias("head"), F.min("fp").alias("fp"), F.min("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()))

    def probes(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                node, fp, sig = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "fp", "sig"))
                row, key = pair_keys(fp.view(np.uint64))
                yield pa.record_batch([pa.array(key), pa.array(node[row]), pa.array(fp[row]), pa.array(sig[row])], names=["key", "id", "fp", "sig"])

    entries = nodes.select("node", "fp", "sig").mapInArrow(probes, "key long, id long, fp long, sig long")
    maybe = connected_components(bucket_pairs(entries, _alike, forest_only=True), folded=True)
    members = maybe.unionByName(maybe.select(F.col("component").alias("id"), "component").distinct())
    asked = members.join(nodes, F.col("id") == F.col("node")).select(F.col("component").alias("key"), "id", "head.k1", "head.k2", "fp", "sig")
    named = asked.select("k1", "k2")
    named = F.broadcast(named) if members.count() <= BROADCAST_ROWS else named
    one_each = keyed.join(named, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("text").alias("text"))  # texts of candidates only
    # rows are numbered in their group; distinct parts of a group are compared pairwise, each part by one task
    sized = asked.groupBy("key").agg(F.ceil(F.count("*") / block).alias("parts"))
    placed = asked.join(sized, "key").withColumn("nth", F.pmod(F.xxhash64("id"), F.col("parts")) * block).drop("parts")
    texts = placed.join(one_each, ["k1", "k2"]).select("key", "nth", F.lit(0).cast("long").alias("by"), "id", "fp", "sig", "text")
    classes = connected_components(block_links(durable(texts), jaccard_links(words, least), block, fold=True), folded=True)
    moved = nodes.join(classes, F.col("node") == F.col("id"), "left").select("h1", "h2", "head", F.coalesce("component", "node").alias("component"))
    heads = moved.groupBy("component").agg(F.min("head").alias("stays"))
    kept = moved.join(heads, "component").select("h1", "h2", "stays")
    return prints.join(kept, ["h1", "h2"]).select("k1", "k2", (here == F.col("stays")).alias("first")).distinct()


def near_key(docs: DataFrame, id_col: str, text_col: str):
    """Columns k1, k2 that tell different (id, text) apart, in the order in which rows stay."""
    return F.struct(F.col(id_col).isNull().alias("without"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id")).alias("k1"), F.xxhash64(F.col(text_col).isNull(), F.col(text_col)).alias("k2")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, least: float = NEAR, block: int = BLOCK) -> DataFrame:
    """docs with one row of each group of near copies, as near_copies has them.

    A row is known by id and text: rows that repeat an id with another text are decided apart, those that
    repeat both are copies, of which one stays, whichever. Null ids take part and come last. Null and empty
    texts are one group. Other columns stay as they are. No rows: no rows.
    """
    n1, n2 = free_names(docs, "k1", "k2")
    k1, k2 = near_key(docs, id_col, text_col)
    keep = near_copies(docs, id_col, text_col, words, least, block).where("first").select(F.col("k1").alias(n1), F.col("k2").alias(n2))
    out = docs.withColumns({n1: k1, n2: k2}).join(keep, [n1, n2], "left_semi")
    return out.dropDuplicates([n1, n2]).select(*(F.col(f"`{c}`") for c in docs.columns))
