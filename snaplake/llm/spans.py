"""Repeated passages: hashes of every run of several consecutive sentences, joined over the corpus.

A sentence ends at a newline or after . ! or ? before a blank; one of over `longest` words counts as several,
cut by content: of every `window` neighbouring places in it, after the word whose hash with the word before is
least. So two copies of a passage are cut alike wherever they start, but for `window` words at either end, and
no piece has more than `window` words. From each sentence on, a run takes the fewest sentences, two at least,
that have `words` words together: by fewer words, runs of one-word sentences would be alike by chance. So a
repeated passage that starts with a sentence and has more than words + longest words holds a whole run, and so
does one within long sentences that has words + 4 windows. Runs are compared by their words, lower-cased,
whatever white space stands between them. Every sentence within a run that occurred before (by id, row and
position) is removed.

The text is hashed once. Of a run that occurs several times in one chunk of documents, all occurrences but the
first are repeats whatever the rest of the corpus holds: they are decided there, and one entry a chunk goes to
the run's bucket, so that a passage in a third of all documents puts as many entries in a task as there are
chunks. Entries are packed, byte ranks apart, and buckets grow in number with the bytes of the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import free_names, slices
from snaplake.llm.linededup import mix, powers, row_key

#: Least words of a run, words beyond which a sentence is cut, least sentences of a run, neighbouring places of which one is cut.
RUN_WORDS, LONGEST, SENTENCES, WINDOW = 25, 20, 2, 10
#: Words hashed at a time in a task, and bytes of text whose runs are compared in one bucket.
CHUNK, BUCKET_BYTES = 2_000_000, 16_000_000
_TOKEN = re.compile(r"\S+")
_ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("k1", "<i8"), ("k2", "<i8"), ("first", "<i4")])


class Words(dict):
    """64-bit hashes of lower-cased words, the lowest bit set for those that end a sentence; kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        ends = word[-1] in ".!?"
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1 << 1 | ends
        return value


def cut_places(words: np.ndarray, inside: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether a long sentence is cut after each word: of some `window` neighbouring places the least by hash, the last of equal ones.

    inside: the number of the long sentence that a word is in, negative elsewhere. The place after a word is
    ranked by the word and the one before it, in the same sentence.
    """
    n = len(words)
    rank = np.zeros(n, np.uint64)
    rank[1:] = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    place = np.zeros(n, bool)
    place[1:] = (inside[1:] >= 0) & (inside[1:] == inside[:-1])
    reach = np.ones(n, np.int64)
    for step, beats in ((-1, np.greater_equal), (1, np.greater)):
        alive = place.copy()
        for k in range(1, window):
            other = np.zeros(n, bool)
            if k < n:
                here, there = (slice(k, None), slice(None, -k)) if step < 0 else (slice(None, -k), slice(k, None))
                other[here] = place[there] & (inside[there] == inside[here]) & beats(rank[there], rank[here])
            alive &= other
            if not alive.any():
                break
            reach += alive
    return place & (reach >= window)


def units_of(texts: list[str], seen: Words, longest: int = LONGEST, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each sentence, the word after its last, its text's number)."""
    tokens: list[str] = []
    sizes, ends = [], []
    for text in texts:
        before = len(tokens)
        for line in text.lower().split("\n"):
            tokens += line.split()
            ends.append(len(tokens))
        sizes.append(len(tokens) - before)
    words = np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
    doc = np.repeat(np.arange(len(texts)), sizes)
    closed = (words & np.uint64(1)).astype(bool)
    ends = np.array(ends, np.int64)
    closed[ends[ends > 0] - 1] = True

    def bounds():
        stop = np.flatnonzero(closed) + 1
        return np.r_[0, stop[:-1]].astype(np.int64) if len(stop) else stop, stop

    start, stop = bounds()
    long = stop - start > longest
    if long.any():
        inside = np.repeat(np.where(long, np.arange(len(start)), -1), stop - start)
        closed |= cut_places(words, inside, window)
        start, stop = bounds()
    return words, start, stop, doc[start] if len(start) else np.empty(0, np.int64)


def runs(start: np.ndarray, stop: np.ndarray, doc: np.ndarray, run_words: int = RUN_WORDS, least: int = SENTENCES) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) sentence of every run, as numbers into start and stop."""
    first = np.arange(len(start))
    last = np.maximum(np.searchsorted(stop, start + run_words), first + least - 1)
    whole = last < len(start)
    whole[whole] = doc[last[whole]] == doc[first[whole]]
    return first[whole], last[whole]


def run_hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of hash of the words from start to stop."""
    power, inverse = powers(len(words) + 1)
    out = []
    for salt in (np.uint64(0), np.uint64(0xA0761D6478BD642F)):
        summed = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words ^ salt) * power[:-1], out=summed[1:])
        out.append(mix((summed[stop] - summed[start]) * inverse[start] + (stop - start).astype(np.uint64)))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def packed(rows: np.ndarray) -> bytes:
    """The rows' bytes, those of equal rank together: ids and places are near-equal in their upper ones."""
    return rows.view(np.uint8).reshape(len(rows), -1).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(_ENTRY.itemsize, -1).T).view(_ENTRY).ravel()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, longest: int = LONGEST, chunk: int = CHUNK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(k1, k2, firsts: list of binary): per row of docs with repeats, the first sentences of its runs that occurred before, packed as 32-bit integers. Keys as in row_key."""
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")).where("text is not null")
    buckets = max(1, -(-int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // bucket_bytes))

    def scan(batches):
        seen = Words()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def closed():
            h1, h2, k1, k2, first = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((first, k2, k1, h2, h1))
            rows = np.empty(len(order), _ENTRY)
            for c, v in zip(_ENTRY.names, (h1, h2, k1, k2, first)):
                rows[c] = v[order]
            same = np.zeros(len(rows), bool)
            same[1:] = (rows["h1"][1:] == rows["h1"][:-1]) & (rows["h2"][1:] == rows["h2"][:-1])
            twin = same.copy()  # rows that repeat an id and text are one: their runs are no repeats of one another
            twin[1:] &= (rows["k1"][1:] == rows["k1"][:-1]) & (rows["k2"][1:] == rows["k2"][:-1]) & (rows["first"][1:] == rows["first"][:-1])
            rows, same = rows[~twin], same[~twin]
            heads, later = rows[~same], rows[same]
            bucket = ((heads["h1"] >> np.uint64(32)).astype(np.int64) * buckets) >> 32
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]).tolist() if len(heads) else []
            places = [int(bucket[a]) for a in cuts[:-1]]
            blobs = [packed(heads[a:b]) for a, b in zip(cuts, cuts[1:])]
            flags = [False] * len(blobs)
            for a in range(0, len(later), 1_000_000):
                part = later[a : a + 1_000_000]
                places.append(int(part["k1"][0]) % buckets)
                blobs.append(packed(part))
                flags.append(True)
            return pa.record_batch([pa.array(places, pa.int64()), pa.array(flags, pa.bool_()), pa.array(blobs, pa.binary())], names=["bucket", "later", "runs"])

        for batch in batches:
            for part in slices(batch, "text"):
                words, start, stop, doc = units_of(part.column("text").to_pylist(), seen, longest)
                if not len(words):
                    continue
                a, b = runs(start, stop, doc, run_words)
                h1, h2 = run_hashes(words, start[a], stop[b])
                k1, k2 = (part.column(c).to_numpy(zero_copy_only=False)[doc[a]] for c in ("k1", "k2"))
                top = np.searchsorted(doc, doc[a])  # the text's first sentence
                held.append((h1, h2, k1, k2, (a - top).astype(np.int32)))
                n += len(words)
                if n >= chunk:
                    yield closed()
                    held, n = [], 0
        if held:
            yield closed()

    def judged(batches):
        now, held, gone = None, [], []

        def closed():
            rows = np.concatenate([*held, np.empty(0, _ENTRY)])
            rows = rows[np.lexsort((rows["first"], rows["k2"], rows["k1"], rows["h2"], rows["h1"]))]
            new = np.ones(len(rows), bool)
            new[1:] = (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])
            head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
            again = (rows["k1"] != head["k1"]) | (rows["k2"] != head["k2"]) | (rows["first"] != head["first"])
            yield from listed(rows[again], False)
            for part in gone:
                yield from listed(part[np.lexsort((part["first"], part["k2"], part["k1"]))], True)

        def listed(rows, by_row):
            """A row for each repeat or, of sorted repeats, for each row of docs."""
            new = np.ones(len(rows), bool)
            if by_row:
                new[1:] = (rows["k1"][1:] != rows["k1"][:-1]) | (rows["k2"][1:] != rows["k2"][:-1])
            cuts = np.r_[np.flatnonzero(new), len(rows)]
            for a in range(0, len(cuts) - 1, 20_000):
                at = cuts[a : a + 20_001]
                firsts = [np.ascontiguousarray(rows["first"][x:y]).tobytes() for x, y in zip(at, at[1:])]
                yield pa.record_batch([pa.array(np.ascontiguousarray(rows["k1"][at[:-1]])), pa.array(np.ascontiguousarray(rows["k2"][at[:-1]])), pa.array(firsts, pa.binary())], names=["k1", "k2", "firsts"])

        for batch in batches:
            for b, later, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "later", "runs"))):
                if b != now:
                    if held or gone:
                        yield from closed()
                    now, held, gone = b, [], []
                (gone if later else held).append(unpacked(blob))
        if held or gone:
            yield from closed()

    entries = texts.mapInArrow(scan, "bucket long, later boolean, runs binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return entries.mapInArrow(judged, "k1 long, k2 long, firsts binary").groupBy("k1", "k2").agg(F.collect_list("firsts").alias("firsts"))


def cut_text(text: str, start: np.ndarray, gone: np.ndarray) -> str:
    """The text without the sentences (by their first words) that are gone; a removed sentence takes the blanks after it with it."""
    place = [m.start() for m in _TOKEN.finditer(text)]
    begin = [place[k] for k in start.tolist()]
    parts = [text[: begin[0]]] + [text[a:b] for a, b, g in zip(begin, [*begin[1:], len(text)], gone.tolist()) if not g]
    return "".join(parts).rstrip() if gone[-1] else "".join(parts)


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, longest: int = LONGEST, chunk: int = CHUNK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with text_col cut, and the columns n_sentences, n_removed (replaced if they are there).

    The first run of its kind by (id, row, position) stays, null ids first; later ones go, within one document
    too. What stood between kept sentences stays as it was; a removed sentence takes the blanks after it with
    it. Null texts stay null, with 0 sentences; empty ones and those with no repeats stay as they are. Rows that
    repeat an id and text are cut alike, as if they were one row. Other columns stay. chunk and bucket_bytes
    change what a task holds, never the result. No rows: no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    gone = repeated_spans(docs, id_col, text_col, run_words, longest, chunk, bucket_bytes)
    n1, n2, found = free_names(docs, "k1", "k2", "firsts")
    k1, k2 = row_key(id_col, text_col)
    gone = gone.select(F.col("k1").alias(n1), F.col("k2").alias(n2), F.col("firsts").alias(found))
    joined = docs.select(*(F.col(f"`{c}`") for c in names), k1.alias(n1), k2.alias(n2)).join(gone, [n1, n2], "left").drop(n1, n2)

    def cut(batches):
        seen = Words()
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            texts = batch.column(text_col).to_pylist()
            words, start, stop, doc = units_of([t or "" for t in texts], seen, longest)
            a, b = runs(start, stop, doc, run_words)
            total = np.bincount(doc, minlength=len(texts))
            top = np.searchsorted(doc, np.arange(len(texts) + 1))
            last = np.full(len(start) + 1, -1)
            last[a] = b
            removed = np.zeros(len(texts), np.int64)
            for r, firsts in enumerate(batch.column(found).to_pylist()):
                if not firsts:
                    continue
                mark = np.zeros(total[r] + 1, np.int64)
                at = np.unique(np.frombuffer(b"".join(firsts), np.int32)).astype(np.int64)
                np.add.at(mark, at, 1)
                np.add.at(mark, last[top[r] + at] - top[r] + 1, -1)
                out = np.cumsum(mark[:-1]) > 0
                removed[r] = int(out.sum())
                units = slice(top[r], top[r + 1])
                texts[r] = cut_text(texts[r], start[units] - start[top[r]], out)
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.record_batch([*columns, pa.array(total, pa.int64()), pa.array(removed)], names=[*names, "n_sentences", "n_removed"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in joined.select(*(f"`{n}`" for n in names)).dtypes), "n_sentences long", "n_removed long"])
    return joined.mapInArrow(cut, schema)
