"""Main text of web pages: suffix arrays over token streams, counted by host, with the pages' own markup as a prior.

A page is cut into blocks of text. The blocks of some pages at a time are concatenated as token streams, and
the suffixes of a stream are put in the order of their host and first `run` tokens, by hash: neighbours in that
array with equal hashes have a common prefix of `run` tokens or more. (A longer common prefix changes nothing:
what a long repeated substring covers is what the runs within it cover, each of which is on as many pages, and
neighbouring runs join to substrings as long as they go.) For every run the distinct pages of its host are
counted, over the whole host however large it is. Pages count by content: each has a signature, the least hash
of its word pairs outside of marked frames, so that copies and most near copies of a page count as one, and what
only they share isn't taken for boilerplate. Pages whose least pair lies in an unmarked block that they share
count as one too: where such blocks have more words than the rest, counts are low.

What repeats decides with what the markup says:

- blocks of no marked article (article, main, or the same by role or itemprop) go if runs on `pages` pages or
  more cover `covered` of their words, unless all such blocks of the page would;
- blocks of a marked article go if runs that are on `share` of the host's pages, and on `widely` pages at least,
  cover them so: copied articles and quoted passages stay, a host's box in every article goes;
- a page with a marked article is that article;
- blocks within navigation, headers, footers, sidebars, forms, notices, adverts and comment sections, as
  elements, roles, class and id names tell, go even where a host shows too few pages to repeat them.

Most runs are on one page only, so counting takes two passes. The first counts leading bits of the runs' hashes
by chunks of pages; what may be on enough pages is marked in a bitmap of `FILTER_BITS`, which lets chance
neighbours through but loses none. The second sends what the bitmap lets through with whole 64-bit hashes and
whole signatures, and counts different signatures exactly, so that a page's text doesn't depend on how many other
pages there are. Both work in buckets of the hashes' leading bits; a run that may be on more pages than `HOT` is
split over buckets by signature and its counts are added up. So a task's share is bounded whatever a host's size.
Pages are read three times and never shuffled, unless more runs are repeated than are broadcast: then pages and
their repeated runs are joined by shuffle, with the same result.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.llm.common import durable, slices
from snaplake.llm.linededup import mix, powers

#: Least tokens of a repeated run, pages that it must occur on, share of a block that must be covered.
RUN, PAGES, COVERED = 6, 3, 0.6
#: Within a marked article: share of the host's pages that a run must be on, and least number of them.
SHARE, WIDELY = 0.5, 5
#: Bits of a run's hash that the bitmap of runs worth counting goes by (2 ** 28 bits are 32 MB); pages from which on a run's signatures are split (more, a hundred-millionth of all bytes, where these are many).
FILTER_BITS, HOT = 28, 100_000
#: Bytes of pages whose runs are counted in one bucket; tokens that one suffix array takes.
SHARD_BYTES, CHUNK = 16_000_000, 1_000_000
#: Repeated runs that are broadcast at most (48 MB); beyond it they are joined by shuffle.
BROADCAST_RUNS = 4_000_000
#: Elements by what their text is.
SKIPPED = frozenset("script style noscript template svg canvas iframe object audio video map title select option button textarea datalist dialog".split())
FRAME = frozenset("nav header footer aside form menu fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names that mark what is no article, and words that say only where or in what shape. A name marks if it has one of the first and none that is in neither.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored sponsors nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside complementary contentinfo header masthead footer comment comments disqus replies reply respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations search pagination pager widget widgets toolbar skip hidden".split())
SHAPES = frozenset("a and area article articles bar block body bottom box btn button buttons c col column container content entry fixed footer form global group header holder icons id inner item items js large left link links list main message middle mobile module outer page panel post posts primary reader right row secondary section site slot small sticky sub tag tags text thread title to top unit user wrap wrapper".split())
HEADS = frozenset("header masthead".split())
OPEN, MARKED, OUTSIDE = 0, 1, 2
#: A tag whose attributes are all plain or in double quotes; others are read quote by quote.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"'=]*+)((?:\s++[^\s<>\"'=/]++(?:=\"[^\"<>]*+\")?+)*+)\s*+(/?)>")
_PLAIN = re.compile(_TAG.pattern + r"|<!--(?:[^-]|-(?!->))*+-->|<![a-zA-Z][^<>]*+>")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_NEXT = re.compile(r">|=\s*+([\"'])")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?(?=[\s/>\"']|$)", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*+>", re.I) for name in SKIPPED}
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LONG_REFERENCE = re.compile(r"&#0*+[0-9]{8,};?")


def _marks(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """(frame, main): whether the element is no article; whether it is marked as one. inside: a marked article surrounds it, whose own head is part of it."""
    frame, main = name in FRAME and not (inside and name == "header"), name in ("article", "main")
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                frame = True
            elif key == "style":
                frame |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif key == "role" and value.lower() in ("article", "main") or key == "itemprop" and value.lower() == "articlebody":
                main = True
            else:
                for token in value.split():
                    words = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
                    marks = words & MARKS - (HEADS if inside else frozenset())
                    frame |= bool(marks) and words <= MARKS | SHAPES
    return frame and name not in ("html", "body"), main


class _Tags:
    """The tags of a page in order, each (start, end, closing, name, attributes); CDATA sections as (start, end, None, text, ""). Reads every byte a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.quoted = True  # False once quotes turned out not to close: they count no more
        self.unclosed: set[str] = set()

    def next(self, at: int):
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            m = _TAG.match(page, start)
            if m:
                return start, m.end(), bool(m.group(1)), m.group(2).lower(), m.group(3) + m.group(4)
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                return start, len(page) if end < 0 else end + 3, None, page[start + 9 : end if end >= 0 else len(page)], ""
            m = _NAME.match(page, start + 1)
            if not m and page[start + 1 : start + 2] not in ("!", "?"):
                at = start + 1
                continue
            end = self._end(m.end() if m else start + 2) if m else page.find(">", start)
            if end < 0:
                return None
            if not m:
                return start, end + 1, False, "", ""
            return start, end + 1, bool(m.group(1)), m.group(2).lower(), page[m.end() : end]

    def _end(self, at: int) -> int:
        """Where the tag ends that goes on at `at`; -1: nowhere."""
        first = at
        while self.quoted:
            m = _NEXT.search(self.page, at)
            if not m:
                self.quoted = False
                break
            if m.group() == ">":
                return m.start()
            quote = m.group(1)
            close = -1 if quote in self.unclosed else self.page.find(quote, m.end())
            if close < 0:
                self.unclosed.add(quote)
                at = m.end()
            else:
                at = close + 1
        return self.page.find(">", first)

    def after(self, name: str, at: int) -> int | None:
        """The end of the next end tag of a skipped element."""
        if name in self.unclosed:
            return None
        m = _CLOSE[name].search(self.page, at)
        if not m:
            self.unclosed.add(name)
            return None
        return m.end()


def unescaped(text: str) -> str:
    """Character references decoded; numbers of eight digits or more are no characters."""
    return entities.unescape(_LONG_REFERENCE.sub("�", text) if "&#" in text else text)


@lru_cache(20_000)
def _told(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    return _marks(name, attributes, inside)


def tags(page: str):
    """The tags of a page, as _Tags has them: at once where all are plain, else one by one."""
    plain, at = [], 0
    if page.rfind("<!--") > page.rfind("-->"):
        return plain, at  # a comment that isn't closed: the pattern would look for its end again and again
    for m in _PLAIN.finditer(page):
        start, end = m.span()
        if page.find("<", at, start) >= 0:
            break
        at = end
        closing, name, attributes, empty = m.groups("")
        plain.append((start, at, closing != "", name.lower(), attributes + empty))
    else:
        if page.find("<", at) < 0:
            return plain, len(page)
    return plain, at


def blocks(page: str) -> tuple[list[str], list[int]]:
    """The texts of the page's blocks, and for each OPEN, MARKED (of a marked article) or OUTSIDE (of the page's frame)."""
    found: list[str] = []
    kinds: list[int] = []
    stack: list[tuple[str, bool, bool]] = []  # element, frame, main; each with what surrounds it
    places: dict[str, list[int]] = {}  # where on the stack an element's name is
    held: list[str] = []
    outer: list[str] = []
    frame = main = False
    reader = _Tags(page)
    known, upto = tags(page)
    known.reverse()
    at = 0

    def flush():
        for parts, kind in ((outer, OUTSIDE), (held, MARKED if main else OPEN)):
            if parts:
                text = " ".join(unescaped("".join(parts)).split())
                parts.clear()
                if text:
                    found.append(text)
                    kinds.append(kind)

    def pop(upto: int):
        while len(stack) > upto:
            places[stack.pop()[0]].pop()
        return stack[-1][1:] if stack else (False, False)

    while True:
        while known and known[-1][0] < at:  # within what was skipped
            known.pop()
        if known:
            start, end, closing, name, attributes = known.pop()
        elif at >= upto == len(page):
            break
        elif (tag := reader.next(max(at, upto) if at < upto else at)) is None:
            break
        else:
            start, end, closing, name, attributes = tag
        if start > at:
            (outer if frame else held).append(page[at:start])
        at = end
        if closing is None:
            (outer if frame else held).append(name.replace("&", "&amp;"))
            continue
        if not name:
            continue
        if name in SKIPPED:
            if not closing:
                after = reader.after(name, at)
                if after or name in ("script", "style"):
                    at = after or len(page)
            continue
        if name == "br":
            (outer if frame else held).append(" ")
            continue
        block = name in BLOCKS
        if block and (held or outer):
            flush()
        if closing:
            if places.get(name):
                k = places[name][-1]
                around = max((places[x][-1] for x in ("article", "main", "body") if places.get(x)), default=-1)
                if k >= around or name in ("html", "body", "main", "article"):  # a stray end tag doesn't close what surrounds it
                    frame, main = pop(k)
            continue
        if name in VOID:
            continue
        if stack and stack[-1][0] == name and name in ("p", "li"):
            frame, main = pop(len(stack) - 1)
        if not attributes and name not in FRAME and name not in ("article", "main"):
            if not block or name in ("p", "li"):
                continue  # changes nothing, nor does its end
            own_frame = own_main = False
        else:
            own_frame, own_main = _told(name, attributes, main) if len(attributes) < 500 else _marks(name, attributes, main)
            if not (own_frame or own_main) and (not block or name in ("p", "li")):
                continue
            if attributes.endswith("/") and not block:
                continue
        frame, main = frame or own_frame, main or own_main
        places.setdefault(name, []).append(len(stack))
        stack.append((name, frame, main))
    if at < len(page):
        (outer if frame else held).append(page[at:].split("<")[0] if re.search(r"<[a-zA-Z/!?]", page[at:]) else page[at:])
    flush()
    return found, kinds


_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of blocks' texts in order, and the number of words of each block.

    Words are told apart by single blanks, which is all the white space that blocks have; their bytes are
    hashed by differences of one running polynomial.
    """
    data = np.frombuffer("\n".join(texts).lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    power, inverse = powers(len(data) + 1)
    summed = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[:-1], out=summed[1:])
    apart = np.flatnonzero((data == 32) | (data == 10))
    start, stop = np.concatenate([[0], apart + 1]), np.concatenate([apart, [len(data)]])
    hashed = mix((summed[stop] - summed[start]) * inverse[start] + (stop - start).astype(np.uint64))
    ends = np.concatenate([np.flatnonzero(data[apart] == 10), [len(apart)]]) + 1
    return hashed, np.diff(np.concatenate([[0], ends]))


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The different numbers, sorted."""
    numbers = np.sort(numbers)
    return numbers[np.r_[True, numbers[1:] != numbers[:-1]]] if len(numbers) else numbers


def run_hashes(words: np.ndarray, host: np.ndarray, run: int = RUN) -> np.ndarray:
    """A 64-bit hash of the run that starts at each word and of its host's hash. The last run - 1 words start none."""
    n = max(0, len(words) - run + 1)
    out = host[:n] * _MULTIPLIERS[0]
    for k in range(run):
        out = (out ^ words[k : k + n]) * _MULTIPLIERS[k % 2]
        out ^= out >> np.uint64(31)
    return out


def host_run(host: np.ndarray) -> np.ndarray:
    """The number under which a host's own pages are counted."""
    return host * _MULTIPLIERS[1] ^ host >> np.uint64(7)


def signature(words: np.ndarray, sizes: np.ndarray | list[int], kinds: list[int]) -> int:
    """The least hash of neighbouring words frames left out (unless there is nothing else)."""
    inside = np.repeat(np.array(kinds) != OUTSIDE, sizes) if len(words) else np.empty(0, bool)
    chosen = words[inside] if inside.any() else words
    if len(chosen) < 2:
        return int(chosen[0]) if len(chosen) else 0
    pair = (chosen[:-1] * _MULTIPLIERS[0]) ^ (chosen[1:] * _MULTIPLIERS[1])
    pair = (pair ^ (pair >> np.uint64(29))) * _MULTIPLIERS[0]
    least = int((pair ^ (pair >> np.uint64(32))).min())
    return (least * int(_MULTIPLIERS[1]) ^ least >> 29) * int(_MULTIPLIERS[0]) & (1 << 64) - 1


def different(h: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs, sorted."""
    order = np.lexsort((signs, h))
    h, signs = h[order], signs[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (signs[1:] != signs[:-1])] if len(h) else np.empty(0, bool)
    return h[new], signs[new]


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, sorted, and for each the sum of its n."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    return h[starts], np.add.reduceat(n, starts) if len(h) else n


def planes(numbers: np.ndarray) -> bytes:
    """Bytes of equal rank together: the leading ones of sorted numbers are alike and pack well."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def unplaned(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


@dataclass
class Chunk:
    """Pages whose token streams stand in a row: words' hashes, and the page of each; hosts' hashes and signatures of each page."""

    words: np.ndarray
    page: np.ndarray
    hosts: np.ndarray
    signs: np.ndarray

    def runs(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, page) of every run of every page, and of the pages' hosts. Runs don't cross pages."""
        n = max(0, len(self.words) - run + 1)
        whole = self.page[:n] == self.page[len(self.page) - n :]
        own = np.arange(len(self.hosts))
        return np.concatenate([run_hashes(self.words, self.hosts[self.page], run)[whole], host_run(self.hosts)]), np.concatenate([self.page[:n][whole], own])


def covered_blocks(sizes: np.ndarray, often: np.ndarray, run: int = RUN, covered: float = COVERED) -> np.ndarray:
    """For blocks in a row, whether repeated runs (often: by the word that each starts at) cover them."""
    mark = np.zeros(int(sizes.sum()) + 1, np.int32)
    at = np.flatnonzero(often)
    mark[at] += 1
    mark[at + run] -= 1
    total = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes] >= covered * sizes


def chosen_text(texts: list[str], kinds: list[int], gone: list[bool], gone_inside: list[bool]) -> str:
    """The main text of a page from its blocks. gone: covered by what repeats; gone_inside: so that a marked article's block goes."""
    marked = [i for i, k in enumerate(kinds) if k == MARKED]
    marked = [i for i in marked if not gone_inside[i]] or marked
    open_ = [i for i, k in enumerate(kinds) if k == OPEN and not gone[i]]
    if not marked:
        chosen = open_ or [i for i, k in enumerate(kinds) if k == OPEN]
    else:
        chosen = marked
    return "\n".join(texts[i] for i in chosen)


@dataclass
class Pages:
    """Some pages in a row: their rows, blocks' texts and kinds by page, words of each block, all words' hashes, and by page the number of its blocks and words, and its host's hash."""

    rows: pa.RecordBatch
    texts: list[list[str]]
    kinds: list[list[int]]
    sizes: np.ndarray
    words: np.ndarray
    n_blocks: np.ndarray
    n_words: np.ndarray
    hosts: np.ndarray

    def runs(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the run that starts at each word, and whether it lies within its page."""
        page = np.repeat(np.arange(len(self.hosts)), self.n_words)
        n = max(0, len(page) - run + 1)
        return run_hashes(self.words, self.hosts[page], run), page[:n] == page[len(page) - n :]


def _paged(batches):
    """The batches' pages, some hundred at a time."""
    for whole in batches:
        for rows in slices(whole, "html"):
            read = [blocks(p) if p else ([], []) for p in rows.column("html").to_pylist()]
            texts, kinds = [t for t, _ in read], [k for _, k in read]
            words, sizes = word_hashes([t for x in texts for t in x])
            n_blocks = np.array([len(x) for x in texts], np.int64)
            ends = np.cumsum(n_blocks)
            total = np.concatenate([[0], np.cumsum(sizes)])
            hosts = np.array([xxhash.xxh64_intdigest(h.encode("utf-8", "surrogatepass")) for h in rows.column("host").to_pylist()], np.uint64)
            yield Pages(rows, texts, kinds, sizes, words, n_blocks, total[ends] - total[ends - n_blocks], hosts)


def _chunks(batches):
    """The batches' pages as chunks of CHUNK words or more; pages without words are left out."""
    held, n = [], 0

    def closed():
        page = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
        return Chunk(np.concatenate([x[0] for x in held]), page, *(np.array([x[k] for x in held], np.uint64) for k in (1, 2)))

    for pages in _paged(batches):
        at = np.concatenate([[0], np.cumsum(pages.n_words)])
        low = np.concatenate([[0], np.cumsum(pages.n_blocks)])
        for k in np.flatnonzero(pages.n_words).tolist():
            words = pages.words[at[k] : at[k + 1]]
            held.append((words, pages.hosts[k], signature(words, pages.sizes[low[k] : low[k + 1]], pages.kinds[k])))
            n += len(words)
        if n >= CHUNK:
            yield closed()
            held, n = [], 0
    if held:
        yield closed()


def _in_buckets(batches, fold, read):
    """(bucket, folded parts) of each bucket of batches sorted by bucket; fold joins parts, copies are folded as they come."""
    now, held, n = None, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if held:
                    yield now, fold(held)
                now, held, n = row["bucket"], [], 0
            held.append(read(row))
            n += len(held[-1][0])
            if n > 4_000_000:
                held = [fold(held)]
                n = 0
    if held:
        yield now, fold(held)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the leading 32 bits."""
    return ((h >> np.uint64(32)).astype(np.int64) * buckets) >> 32


def worth_counting(rows: DataFrame, run: int, least_pages: int, buckets: int, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bitmap of the runs that may be on least_pages pages, by leading bits of their hashes, and the leading bits of those that may be on over `hot` pages, sorted, with the number of pages at most.

    A run's pages are counted chunk by chunk and added up, runs with the same leading bits together, so no count
    is too low. The bitmap has the same size whatever the corpus.
    """

    def scan(batches):
        for chunk in _chunks(batches):
            h, page = chunk.runs(run)
            _, sign = np.unique(chunk.signs, return_inverse=True)
            low = np.uint64(len(sign).bit_length())
            found = distinct((h >> np.uint64(64 - bits)) << low | sign[page].astype(np.uint64)) >> low
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            n = np.diff(np.r_[starts, len(found)]).astype(np.uint32)
            found = found[starts] << np.uint64(64 - bits)
            bucket = _bucket_of(found, buckets)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            parts = list(zip(cuts, cuts[1:]))
            yield pa.record_batch([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array([planes(found[a:b]) for a, b in parts], pa.binary()), pa.array([planes(n[a:b]) for a, b in parts], pa.binary())], names=["bucket", "runs", "n"])

    def marked(batches):
        read = lambda row: (unplaned(row["runs"], np.uint64), unplaned(row["n"], np.uint32).astype(np.int64))
        fold = lambda held: summed(*(np.concatenate(x) for x in zip(*held)))
        for _, (h, n) in _in_buckets(batches, fold, read):
            chosen = h[n >= least_pages]
            if len(chosen):
                slots = (chosen >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                first = int(slots[0]) >> 3
                on = np.zeros(((int(slots[-1]) >> 3) - first + 1) * 8, np.uint8)
                on[slots - first * 8] = 1
                yield pa.record_batch([pa.array([first], pa.int64()), pa.array([np.packbits(on).tobytes()], pa.binary()), pa.array([np.stack([h[n > hot].view(np.int64), n[n > hot]]).tobytes()], pa.binary())], names=["first", "slots", "hot"])

    packed = rows.select("host", "html").mapInArrow(scan, "bucket long, runs binary, n binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    bitmap, often = np.zeros(1 << FILTER_BITS - 3, np.uint8), [np.empty((2, 0), np.int64)]
    for row in packed.mapInArrow(marked, "first long, slots binary, hot binary").collect():  # the bitmap's bytes, a piece a bucket
        bitmap[row.first : row.first + len(row.slots)] |= np.frombuffer(row.slots, np.uint8)
        often.append(np.frombuffer(row.hot, np.int64).reshape(2, -1))
    h, n = np.concatenate(often, axis=1)
    order = np.argsort(h.view(np.uint64))
    return bitmap, h.view(np.uint64)[order], n[order]


def repeated_runs(rows: DataFrame, run: int, least_pages: int, shard_bytes: int, hot: int | None = None) -> DataFrame:
    """(h, n) of the runs that occur on least_pages pages of a host or more, and of the hosts with as many (under host_run); n is exact. rows has host, html."""
    total = int(rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0)
    buckets, bits = int(max(1, -(-total // shard_bytes))), min(44, max(32, total.bit_length() + 3))
    hot = hot or max(HOT, total // 100_000_000)
    bitmap, often, most = worth_counting(rows, run, least_pages, buckets, bits, hot)
    parts = -(-most // hot)  # of each hot run
    spread = int(parts.sum())
    known = rows.sparkSession.sparkContext.broadcast((bitmap, often, parts))

    def scan(batches):
        bitmap, often, parts = known.value
        for chunk in _chunks(batches):
            h, page = chunk.runs(run)
            slot = h >> np.uint64(64 - FILTER_BITS)
            on = bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8) & 1 > 0
            h, signs = different(h[on], chunk.signs[page[on]])
            if not len(h):
                continue
            bucket = _bucket_of(h, buckets)
            if len(often):
                lead = h >> np.uint64(64 - bits) << np.uint64(64 - bits)
                at = np.minimum(np.searchsorted(often, lead), len(often) - 1)
                split = often[at] == lead
                own = (h ^ (signs % parts[at].astype(np.uint64)) * _MULTIPLIERS[1]) * _MULTIPLIERS[0]
                bucket = np.where(split, buckets + _bucket_of(own ^ own >> np.uint64(29), spread), bucket)
                order = np.argsort(bucket, kind="stable")
                h, signs, bucket = h[order], signs[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            out = []
            for a, b in zip(cuts, cuts[1:]):
                table, which = np.unique(signs[a:b], return_inverse=True)
                out.append((planes(h[a:b]), table.tobytes(), planes(which.astype(np.uint32))))
            yield pa.record_batch([pa.array(bucket[cuts[:-1]], pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*out))], names=["bucket", "runs", "signs", "which"])

    def counted(batches):
        read = lambda row: (unplaned(row["runs"], np.uint64), np.frombuffer(row["signs"], np.uint64)[unplaned(row["which"], np.uint32)])
        fold = lambda held: different(*(np.concatenate(x) for x in zip(*held)))
        for b, (h, _) in _in_buckets(batches, fold, read):
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            n = np.diff(np.r_[starts, len(h)])
            keep = n >= (least_pages if b < buckets else 1)  # parts of a hot run are added up yet
            yield pa.record_batch([pa.array(h[starts][keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["h", "n"])

    packed = rows.select("host", "html").mapInArrow(scan, "bucket long, runs binary, signs binary, which binary").repartition(buckets + spread, "bucket").sortWithinPartitions("bucket")
    counts = packed.mapInArrow(counted, "h long, n long")
    return counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least_pages) if spread else counts


def times_of(hashes: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The times of each hash in the known ones, sorted as signed numbers; 0 if it isn't there."""
    hashes = hashes.view(np.int64)
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, times[at], 0)


def main_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    run: int = RUN,
    least_pages: int = PAGES,
    covered: float = COVERED,
    share: float = SHARE,
    widely: int = WIDELY,
    shard_bytes: int = SHARD_BYTES,
    broadcast_runs: int = BROADCAST_RUNS,
    hot: int | None = None,
) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Blocks are joined by newlines in page order; white space within a block is one space. Null, empty and
    text-free pages have an empty text; null ids and urls are carried (pages with no host in their url are
    one host); repeated rows each get a row and count as one page of their host; other columns don't matter.
    Tags that aren't closed end the text. shard_bytes, broadcast_runs and hot change what a task holds, never the
    result. No rows: no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = rows.withColumn("host", host)
    repeats = durable(repeated_runs(rows, run, least_pages, shard_bytes, hot))
    if repeats.count() <= broadcast_runs:
        table = repeats.orderBy("h").toArrow()
        shared = pages.sparkSession.sparkContext.broadcast((table.column("h").to_numpy(), table.column("n").to_numpy()))
    else:
        shared = None

        def runs_of(batches):
            for some in _paged(batches):
                hashes, whole = some.runs(run)
                row = some.rows.column("row").to_numpy()
                of = np.concatenate([np.repeat(row, some.n_words)[: len(hashes)][whole], row])
                yield pa.record_batch([pa.array(of), pa.array(np.concatenate([hashes[whole], host_run(some.hosts)]).view(np.int64))], names=["row", "h"])

        rows = rows.withColumn("row", F.xxhash64("host", "html"))  # equal rows have equal runs
        hits = rows.select("row", "host", "html").mapInArrow(runs_of, "row long, h long").distinct().join(repeats, "h").groupBy("row")
        rows = rows.join(hits.agg(F.array_sort(F.collect_list(F.struct("h", "n"))).alias("hits")), "row", "left")

    def judged(batches):
        for some in _paged(batches):
            hashes, whole = some.runs(run)
            own = host_run(some.hosts)
            if shared:
                on, of = (times_of(x, *shared.value) for x in (hashes, own))
            else:
                on, of = np.zeros(len(hashes), np.int64), np.zeros(len(own), np.int64)
                at = 0
                for k, hits in enumerate(some.rows.column("hits").to_pylist()):
                    known, times = np.array([x["h"] for x in hits or ()], np.int64), np.array([x["n"] for x in hits or ()], np.int64)
                    part = slice(at, at + int(some.n_words[k]))
                    on[part], of[k] = times_of(hashes[part], known, times), times_of(own[k : k + 1], known, times)[0]
                    at = part.stop
            on = np.where(whole, on, 0)
            strict = np.repeat(np.maximum(widely, share * of), some.n_words)[: len(on)]
            gone, inside = (covered_blocks(some.sizes, often, run, covered) for often in (on >= least_pages, on >= strict))
            low = np.concatenate([[0], np.cumsum(some.n_blocks)]).tolist()
            gone, inside = gone.tolist(), inside.tolist()
            out = [chosen_text(t, k, gone[a:b], inside[a:b]) for t, k, a, b in zip(some.texts, some.kinds, low, low[1:])]
            yield pa.record_batch([some.rows.column("page_id"), some.rows.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    out = rows.mapInArrow(judged, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
