"""Byte-level BPE over whole texts, split where the vocabulary makes a token boundary certain.

A pair of bytes that occurs inside no token of the vocabulary can never be merged, so a token ends between
them wherever they meet. A text is first cut before each run of white space, where the pre-tokenizer starts
afresh whatever came before; within a pre-token every pair of bytes that no token holds is a cut. The
fragments are encoded independently and their ids concatenated; ids of frequent words are kept per task.
"""

from __future__ import annotations

import heapq
import json
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplake.llm.common import slices

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the characters that the pattern's \\s takes as white space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces kept per task, and the longest of them in characters.
CACHED, CACHED_CHARS = 400_000, 64
#: A merge is one number, its rank above the id that it makes; pairs without one, and pairs that no token holds.
_ID_BITS, _NO_MERGE, _FORCED = 24, 1 << 60, 1 << 61
#: Fragments of up to so many bytes are merged by scans of a list, longer ones with a heap.
_SCANNED = 96


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 is itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary from a tokenizer file: what the tasks need, with methods to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        stand_in = _byte_alphabet()
        as_bytes = lambda token: bytes(stand_in[c] for c in token)
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: as_bytes(t) for t, i in vocab.items() if t not in special}
        self.byte_id = [vocab[c] for c, _ in sorted(stand_in.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[left] << 32 | vocab[right]] = rank << _ID_BITS | vocab[left + right]
        joined = np.zeros((256, 256), bool)
        for token in tokens.values():
            codes = np.frombuffer(token, np.uint8)
            joined[codes[:-1], codes[1:]] = True
        merge_of = lambda a, b: self.merges.get(self.byte_id[a] << 32 | self.byte_id[b], _NO_MERGE)
        self.first = [[merge_of(a, b) if joined[a, b] else _FORCED for b in range(256)] for a in range(256)]
        self.special = special
        tokens |= {i: t.encode() for t, i in special.items()}
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.length = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.table = np.frombuffer(b"".join(parts), np.uint8)
        self._ready = False

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("cache", "words", "pattern", "specials")} | {"_ready": False}

    def _prepare(self):
        self.cache: dict[str, bytes] = {}
        self.words = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+").findall
        self.pattern = regex.compile(PATTERN).findall
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self._ready = True

    def merged(self, ids: list[int], pairs: list[int]) -> list[int]:
        """Ids of a fragment, from those of its bytes and the merges of its pairs: the lowest-ranked pair first,
        the leftmost of equals. Scans for short fragments, O(n log n) for long ones."""
        if len(ids) > _SCANNED:
            return self._merged_by_heap(ids)
        merge_of, made = self.merges.get, (1 << _ID_BITS) - 1
        while pairs and (best := min(pairs)) < _NO_MERGE:
            i = pairs.index(best)
            ids[i] = new = best & made
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = merge_of(ids[i - 1] << 32 | new, _NO_MERGE)
            if i < len(pairs):
                pairs[i] = merge_of(new << 32 | ids[i + 1], _NO_MERGE)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        n, merges, made = len(ids), self.merges, (1 << _ID_BITS) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p], i, p) for i in range(n - 1) if (p := ids[i] << 32 | ids[i + 1]) in merges]
        heapq.heapify(heap)
        while heap:
            merge, i, pair = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i], ids[j] = merge & made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := ids[i] << 32 | ids[after[i]]) in merges:
                    heapq.heappush(heap, (merges[p], i, p))
            if before[i] >= 0 and (p := ids[before[i]] << 32 | ids[i]) in merges:
                heapq.heappush(heap, (merges[p], before[i], p))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        tokens = self.pattern(piece)
        if len(tokens) > 1:
            return self._keep(piece, b"".join(self.cache.get(t) or self._token(t) for t in tokens))
        return self._token(piece)

    def _token(self, token: str) -> bytes:
        """The pre-token, cut at its forced boundaries; the fragments' ids one after another."""
        data, first, byte_id = token.encode("utf-8", "replace"), self.first, self.byte_id
        ids, pairs = [byte_id[b] for b in data], [first[a][b] for a, b in zip(data, data[1:])]
        if _FORCED in pairs:
            ends = [0, *(k for k, pair in enumerate(pairs, 1) if pair == _FORCED), len(data)]
            ids = [i for a, b in zip(ends, ends[1:]) for i in self.merged(ids[a:b], pairs[a : b - 1])]
        else:
            ids = self.merged(ids, pairs)
        return self._keep(token, struct.pack(f"<{len(ids)}I", *ids))

    def _keep(self, piece: str, packed: bytes) -> bytes:
        if len(piece) <= CACHED_CHARS:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit integers."""
        if not self._ready:
            self._prepare()
        if not text:
            return b""
        out = []
        for k, part in enumerate(self.specials(text) if self.specials else [text]):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                get, piece = self.cache.get, self._piece
                out += [get(w) or piece(w) for w in self.words(part)]
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, special tokens as their strings; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if not len(ids):
            return ""
        length = self.length[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        return self.table[at].tobytes().decode("utf-8", "replace")


def _shared(spark: SparkSession, vocabulary: str | Vocabulary):
    """Sent to each executor once; a vocabulary has a few MB whatever the corpus."""
    return spark.sparkContext.broadcast(vocabulary if isinstance(vocabulary, Vocabulary) else Vocabulary(vocabulary))


def bpe_encode(docs: DataFrame, vocabulary: str | Vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the column ids_col in place of text_col: the ids of the whole text, packed as little-endian
    unsigned 32-bit integers (binary). Null and empty texts: no ids. Other columns stay as they are, those
    called ids_col are replaced; any number of equal rows is encoded alike. No rows: no rows."""
    shared = _shared(docs.sparkSession, vocabulary)
    kept = docs.drop(*({ids_col} - {text_col}))
    names = [ids_col if c == text_col else c for c in kept.columns]
    schema = ", ".join(f"`{n}` {'binary' if c == text_col else t}" for n, (c, t) in zip(names, kept.dtypes))

    def scan(batches):
        vocab = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                ids = pa.array([vocab.encode(t) for t in part.column(text_col).to_pylist()], pa.binary())
                yield pa.record_batch([ids if c == text_col else part.column(c) for c in part.schema.names], names=names)

    return kept.mapInArrow(scan, schema)


def bpe_decode(encoded: DataFrame, vocabulary: str | Vocabulary, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with the further column text_col: the text of the packed ids of ids_col. Null ids: an empty text."""
    shared = _shared(encoded.sparkSession, vocabulary)
    kept = encoded.drop(text_col)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), f"`{text_col}` string"])

    def scan(batches):
        vocab = shared.value
        for batch in batches:
            for part in slices(batch, ids_col):
                text = pa.array([vocab.decode(x or b"") for x in part.column(ids_col).to_pylist()], pa.string())
                yield pa.record_batch([*part.columns, text], names=[*part.schema.names, text_col])

    return kept.mapInArrow(scan, schema)


def bpe_digests(docs: DataFrame, vocabulary: str | Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids."""
    both = bpe_decode(bpe_encode(docs.select("doc_id", "text"), vocabulary), vocabulary, text_col="decoded")
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
