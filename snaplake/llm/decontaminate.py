"""Benchmark items inside documents: size-partitioned MinHash containment search.

A document leaks an item if it holds at least `least` of the item's different shingles of five words. Items
fall into size classes by powers of two of their shingle count. An item's sketch is its m least shingle
hashes (bottom-m MinHash) with m = n - ceil(least * n) + 1: a document without any of these lacks too many
shingles to hold `least` of them, so no leak is missed however long the document is. Each class has a
largest sketch hash; a document's shingles beyond it need no lookup in that class. Candidates are verified
by exact containment of their shingle sets: by hashes first, then by the words themselves.

Items of fewer than five words are one shingle of their own length: for each such length that a block has, the
document's runs of so many words are looked up, and the words compared.

Items are taken in blocks of bounded size, each broadcast once, and every block passes over the documents:
what a task holds grows neither with the documents nor with the benchmark, and documents are not shuffled.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a shingle, and the least part of an item's shingles that makes a leak.
WORDS, LEAST = 5, 0.8
#: Shingles of the items that are broadcast at once (at most some 40 MB).
BLOCK_SHINGLES = 1_000_000
_WORD = re.compile(r"\w+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)


class Hashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        return value


def tokens_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


def all_shingles(hashed: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes, in order, of the runs of `words` words with these hashes. Fewer words: one run of them all; none: nothing."""
    if not len(hashed):
        return np.empty(0, np.uint64)
    n = max(1, len(hashed) - words + 1)
    total = np.full(n, min(words, len(hashed)), np.uint64)
    for k in range(min(words, len(hashed))):
        total += hashed[k : k + n] * _FACTORS[k % 8] + np.uint64(k // 8)
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return total ^ (total >> np.uint64(29))


def unique_shingles(hashed: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The different ones of all_shingles, sorted."""
    return np.unique(all_shingles(hashed, words))


def shingle_hashes(text: str | None, seen: dict, words: int = WORDS) -> np.ndarray:
    """Different hashes, sorted, of the text's shingles."""
    tokens = tokens_of(text)
    return unique_shingles(np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens)), words)


class ItemBlock:
    """Sketches and shingles of some items, to be searched with one document at a time."""

    def __init__(self, items: list[tuple[int, str]], least: float, words: int):
        seen = Hashes()
        self.words, self.least = words, least
        self.items = [(i, s, tokens_of(t)) for i, t in items if len(s := shingle_hashes(t, seen, words))]
        sketch = [s[: len(s) - math.ceil(least * len(s) - 1e-9) + 1] for _, s, _ in self.items]
        self.classes, self.short = [], {}
        n_words = np.array([len(w) for _, _, w in self.items], np.int64)
        for n in np.unique(n_words[n_words < words]).tolist():
            rows = np.flatnonzero(n_words == n)
            key = np.concatenate([sketch[r] for r in rows])
            order = np.argsort(key, kind="stable")
            self.short[n] = key[order], rows[order]
        size = np.array([len(s).bit_length() if len(w) >= words else 0 for _, s, w in self.items])
        for c in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == c)
            key = np.concatenate([sketch[r] for r in rows])
            owner = np.repeat(rows, [len(sketch[r]) for r in rows])
            order = np.argsort(key, kind="stable")
            self.classes.append((key[order].max(), key[order], owner[order]))

    def runs(self, tokens: list[str], at) -> set[tuple[str, ...]]:
        return {tuple(tokens[k : k + self.words]) for k in at}

    def search_short(self, tokens: list[str], hashed: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, 1, 1) of the items of fewer than `words` words that stand anywhere in a document."""
        found = set()
        for n, (key, owner) in self.short.items():
            if len(tokens) < n:
                continue
            runs = all_shingles(hashed, n)
            low, high = np.searchsorted(key, runs, "left"), np.searchsorted(key, runs, "right")
            seen = set()
            for k in np.flatnonzero(high > low).tolist():
                run = tuple(tokens[k : k + n])
                if run not in seen:
                    seen.add(run)
                    found.update(o for o in owner[low[k] : high[k]].tolist() if tuple(self.items[o][2]) == run)
        return [(self.items[o][0], 1, 1) for o in sorted(found)]

    def search(self, text: str | None, seen: dict) -> list[tuple[int, int, int]]:
        """(item, shared shingles, item's shingles) of every leak in a document."""
        tokens = tokens_of(text)
        hashed = np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
        every = all_shingles(hashed, self.words)
        shingles = np.unique(every)
        if not len(shingles):
            return []
        out = self.search_short(tokens, hashed)
        if len(tokens) < self.words:
            return out
        for largest, key, owner in self.classes:
            probe = shingles[: np.searchsorted(shingles, largest, "right")]
            if len(probe) < len(key):
                low, high = np.searchsorted(key, probe, "left"), np.searchsorted(key, probe, "right")
                hit = np.flatnonzero(high > low)
                found = {int(o) for k in hit for o in owner[low[k] : high[k]]}
            else:
                at = np.searchsorted(probe, key)
                found = {int(o) for o in owner[probe[np.minimum(at, len(probe) - 1)] == key]} if len(probe) else set()
            for k in sorted(found):
                item, own, words = self.items[k]
                at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
                if int((shingles[at] == own).sum()) < self.least * len(own) - 1e-9:
                    continue
                wanted = self.runs(words, range(max(1, len(words) - self.words + 1)))
                shared = len(wanted & self.runs(tokens, np.flatnonzero(np.isin(every, own)).tolist()))
                if shared >= self.least * len(wanted) - 1e-9:
                    out.append((item, shared, len(wanted)))
        return out


def _blocks(items: DataFrame, item_col: str, text_col: str):
    """Blocks of items, read in turn: the driver holds one at a time."""
    block, size = [], 0
    for item, text in items.select(F.col(item_col).cast("long"), text_col).where(f"`{text_col}` is not null").distinct().toLocalIterator():
        n = sum(1 for _ in _WORD.finditer(text))
        if block and size + n > BLOCK_SHINGLES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every leak.

    Words are lower-cased runs of word characters, whatever stands between them. Items without words leak
    nowhere, items of fewer than `words` words are one shingle of all their words, found wherever these stand in
    a row (a one-word item in every document with the word: choose items with care); null and blank documents hold nothing; null
    ids are carried as null. Repeated documents each get rows, repeated items (same id and text) count once.
    Other columns don't matter. No documents or no items: no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shared long, n_item long"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    parts = []
    for block in _blocks(items, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(ItemBlock(block, least, words))

        def scan(batches, shared=shared):
            seen, items = Hashes(), shared.value
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in items.search(t, seen)]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "n_shared", "n_item"])

        parts.append(texts.mapInArrow(scan, schema))
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST, words: int = WORDS) -> DataFrame:
    """docs without those that leak an item. Defined row by row, so that null and repeated ids are no matter; columns stay as they are."""
    spark = docs.sparkSession
    out = docs
    for block in _blocks(items, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(ItemBlock(block, least, words))

        def scan(batches, shared=shared):
            seen, items = Hashes(), shared.value
            for batch in batches:
                clean = [not t or not items.search(t, seen) for t in batch.column(text_col).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(scan, docs.schema)
    return out
