"""Line dedup, passages, SimHash and decontamination against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from snaplake.llm import decontaminate as dec
from snaplake.llm import linededup as ld
from snaplake.llm import simhash as sh
from snaplake.llm import spans as sp


def edit_distance(a, b):
    start = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[start:], b[start:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def mutate(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text) + 1)
        kind = rng.randrange(3)
        text = text[:i] + (rng.choice("abcé ") if kind else "") + text[i + (kind != 1) :]
    return text.strip()


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_band_equals_full_edit_distance():
    rng = random.Random(5)
    left = [words(rng, rng.randint(1, 9)) for _ in range(400)]
    right = [mutate(rng, x, rng.randint(0, 5)) for x in left]
    for edits in (1, 2, 3):
        assert ld.within_edits(left, right, edits).tolist() == [edit_distance(a, b) <= edits for a, b in zip(left, right)]


def test_segment_keys_meet_for_all_close_lines():
    rng = random.Random(6)
    for edits in (1, 2, 3):
        for _ in range(150):
            a = words(rng, rng.randint(3, 12))
            b = mutate(rng, a, edits)
            both = [ld.segment_keys(np.frombuffer(x.encode("utf-32-le"), "<u4"), np.array([len(x)]), edits) for x in (a, b)]
            (_, ka, oa), (_, kb, ob) = both
            assert set(ka[oa]) & set(kb) or set(kb[ob]) & set(ka)


def brute_lines(rows, edits, every):
    """Text per row, rows as distinct (id, text)."""
    seen = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    at = [(i, p, line.strip(ld.BLANKS)) for i, (_, t) in enumerate(seen) if t is not None for p, line in enumerate(t.split("\n")) if line.strip(ld.BLANKS)]
    links = [(a, b) for a in range(len(at)) for b in range(a) if at[a][2] == at[b][2] or abs(len(at[a][2]) - len(at[b][2])) <= edits and 0 < min(len(at[a][2]), len(at[b][2])) // every and edit_distance(at[a][2], at[b][2]) <= min(edits, len(at[a][2]) // every, len(at[b][2]) // every)]
    gone = {(i, p) for (i, p, _), r, k in zip(at, components(len(at), links), range(len(at))) if r != k}
    return {(d, t): None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, (d, t) in enumerate(seen)}


def test_line_dedup_equals_brute_force(spark, docs_of):
    rng = random.Random(7)
    base = [words(rng, n) for n in (1, 2, 2, 3, 3, 4, 4, 5, 6, 8, 9, 12, 14, 16)] + ["abcdefghijk", "abcdefghijklmnopqrstuvw"]
    rows = []
    for i in range(60):
        parts = [mutate(rng, rng.choice(base), rng.choice((0, 0, 1, 2, 4))) for _ in range(rng.randint(1, 5))]
        rows.append((i, "\n".join(parts + ["ab", " \t", ""][: rng.randint(0, 3)])))
    rows += [(90, None), (91, ""), (92, "\n\n"), (5, rows[5][1]), (None, "null id line\nab"), (93, "x" * 100_000), (94, "x" * 100_001)]
    out = ld.line_dedup(docs_of(rows, n_lines="x", removed="y", h1="z", k1="w", _k1="a", _K2="b", gone="c", _gone="d"), report=True, every=12)
    expected = brute_lines(rows, 2, 12)
    got = out.collect()
    assert len(got) == len(rows) and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text or "", r.text is None) for r in got) == sorted(((d is None, d or 0), expected[d, t] or "", expected[d, t] is None) for d, t in rows)
    assert {r.n_lines for r in got if r.doc_id == 90} == {0}


def test_many_small_groups_are_compared_together(monkeypatch):
    rng = random.Random(9)
    rows = []
    for k in range(300):
        stem = words(rng, rng.randint(6, 12))
        rows += [(k, 1 + k % 2, mutate(rng, stem, rng.randint(0, 2))) for _ in range(rng.randint(2, 5))]
    ids = list(range(len(rows)))
    table = pa.table({"key": pa.array([r[0] for r in rows]), "apart": pa.array([r[1] for r in rows], pa.int32()), "h1": pa.array(ids), "line": [r[2] for r in rows]})
    links = [(a, b) for a in ids for b in ids[a + 1 : a + 5] if b < len(rows) and rows[a][0] == rows[b][0] and edit_distance(rows[a][2], rows[b][2]) <= rows[a][1]]
    expected, calls, verify = components(len(ids), links), [], ld.within_edits
    monkeypatch.setattr(ld, "within_edits", lambda *x: calls.append(x) or verify(*x))
    for size, step, most in ((ld._SLICE, 7, 2), (20_000, 7, 100), (20_000, 1000, 100), (1, 7, 600)):
        monkeypatch.setattr(ld, "_SLICE", size)
        calls.clear()
        got = [pair for x in ld.group_links(table.slice(k, step).combine_chunks().to_batches()[0] for k in range(0, len(ids), step)) for pair in zip(*x.to_pydict().values())]
        assert components(len(ids), got) == expected and 0 < len(calls) <= most


def test_calls_that_verify_do_not_grow_with_groups(spark, docs_of, monkeypatch):
    rng = random.Random(12)
    stems = [words(rng, 10) for _ in range(60)]
    lines = ld.lines_of(docs_of([(k, s + "\n" + s[:-1] + "#") for k, s in enumerate(stems)]), "doc_id", "text")
    seen, calls, verify = [], [], ld.within_edits
    monkeypatch.setattr(ld, "_in_groups", lambda groups, work: seen.append((groups, work)) or groups.selectExpr("h1 a", "h1 b"))
    ld.line_links(lines)
    groups, work = seen[0]
    monkeypatch.setattr(ld, "within_edits", lambda *x: calls.append(x) or verify(*x))
    links = {pair for x in work(groups.orderBy("key", "h1").toArrow().to_batches()) for pair in zip(*x.to_pydict().values())}
    assert len(links) == 60 and groups.select("key").distinct().count() >= 60 and 0 < len(calls) <= 4


def test_keys_are_those_of_whole_lines(monkeypatch):
    rng = random.Random(10)
    lines = pa.array([words(rng, rng.randint(1, 12)) + rng.choice(["", "\U0001f600", "中"]) for _ in range(200)])
    points, lengths = ld.code_points(lines)
    assert "".join(map(chr, points)) == "".join(lines.to_pylist()) and lengths.tolist() == [len(x) for x in lines.to_pylist()]
    assert [r for low, high in ld.runs_of(lines, 100) for r in range(low, high)] == list(range(200))
    row, key, own = ld.segment_keys(points, lengths, 2)
    monkeypatch.setattr(ld, "_HASHED", 1)
    for r in range(0, 200, 20):
        _, alone, mine = ld.segment_keys(*ld.code_points(lines.slice(r, 1)), 2)
        assert key[row == r].tolist() == alone.tolist() and own[row == r].tolist() == mine.tolist()
        assert ld.line_counts(points, lengths)[r] == ld.letter_counts(ld.code_points(lines.slice(r, 1))[0]).sum()


def test_every_blank_is_cut_from_the_ends_of_lines(spark, docs_of):
    rng = random.Random(11)
    texts = ["\n".join("".join(rng.choice(ld.BLANKS) for _ in range(rng.randint(0, 3))) + x + "".join(rng.choice(ld.BLANKS) for _ in range(rng.randint(0, 3))) for x in ("", "a", "a b", "é\u2003", "中\u3000文")) for _ in range(40)]
    got = {(r.k1, r.pos): r.line for r in ld.lines_of(docs_of(list(enumerate(texts))), "doc_id", "text").collect()}
    assert got == {(i, p): x.strip(ld.BLANKS) for i, t in enumerate(texts) for p, x in enumerate(t.split("\n")) if x.strip(ld.BLANKS)}


def test_large_groups_of_lines_are_dealt_out_in_blocks(spark, docs_of):
    rng = random.Random(8)
    stem = words(rng, 12)
    rows = [(i, mutate(rng, stem, 2) + str(i % 3)) for i in range(60)]
    lines = ld.lines_of(docs_of(rows), "doc_id", "text")
    from snaplake.llm.common import connected_components

    small, whole = (sorted(map(tuple, connected_components(ld.line_links(lines, 2, 12, block)).collect())) for block in (7, 1024))
    assert small == whole and whole


@pytest.mark.parametrize("op", [lambda d: ld.line_dedup(d), lambda d: sp.span_dedup(d), lambda d: sh.simhash_dedup(d), lambda d: sh.simhash_groups(d)])
def test_empty_tables(spark, docs_of, op):
    assert op(docs_of([])).count() == 0


def word_rank(a, b):
    """What decides where a long sentence is cut, of two neighbouring words."""
    m = (1 << 64) - 1
    a, b = (xxhash.xxh64_intdigest(w.lower().encode()) >> 1 << 1 | (w[-1] in ".!?") for w in (a, b))
    x = (a * 0x9E3779B97F4A7C15 + b) & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def brute_sentences(text):
    """Lists of words."""
    plain = [x.split() for line in text.split("\n") for x in re.split(r"(?<=[.!?])\s+", line)]
    out = []
    for w in filter(None, plain):
        at = set()
        if len(w) > 20:
            ranks = {k: word_rank(w[k - 1], w[k]) for k in range(1, len(w))}
            for low in range(1, len(w) - 9):
                at.add(max((k for k in range(low, low + 10)), key=lambda k: (-ranks[k], k)) + 1)
        ends = [0, *sorted(k for k in at if k < len(w)), len(w)]
        out += [w[a:b] for a, b in zip(ends, ends[1:])]
    return out


def brute_spans(rows):
    seen = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = set(), {}
    for d, t in seen:
        units = brute_sentences(t or "")
        gone = set()
        for a in range(len(units)):
            b = a + 1
            while b < len(units) and sum(map(len, units[a : b + 1])) < 25:
                b += 1
            if b >= len(units):
                break
            key = " ".join(w for u in units[a : b + 1] for w in u).lower()
            if key in first:
                gone.update(range(a, b + 1))
            first.add(key)
        out[d, t] = [" ".join(u) for k, u in enumerate(units) if k not in gone], len(units), len(gone)
    return out


def test_spans_equal_brute_force_and_catch_passages(spark, docs_of):
    rng = random.Random(9)
    prose = lambda n: " ".join(words(rng, rng.randint(2, 25)).capitalize() + rng.choice(".!?") for _ in range(n))
    passage = prose(1)
    while len(passage.split()) <= 50:
        passage += " " + prose(1)
    rows = [(i, f"{prose(4)}\n{passage if i % 3 == 0 else prose(2)} {prose(3)}") for i in range(30)]
    rows += [(100, rows[4][1]), (101, rows[4][1].replace(". ", ".\n")), (102, None), (103, ""), (104, words(rng, 70) + ". " + "x " * 200), (4, rows[4][1]), (None, prose(3))]
    docs = docs_of(rows, n_removed="x", firsts="y", K1="z").repartition(3)
    out = sp.span_dedup(docs).collect()
    small = sp.span_dedup(docs, chunk=200, bucket_bytes=3_000)
    assert small.columns == [*docs_of([], firsts="y", K1="z").columns, "n_sentences", "n_removed"] and sorted(map(str, small.collect())) == sorted(map(str, out))
    expected = brute_spans(rows)
    by = {(d, t) for d, t in rows}
    assert len(out) == len(rows) and len(by) == len(rows) - 1
    text = lambda r: " ".join((r.text or "").split())
    assert sorted((r.doc_id or -1, text(r), r.n_sentences, r.n_removed) for r in out) == sorted((d or -1, " ".join(expected[d, t][0]), *expected[d, t][1:]) for d, t in rows)
    assert [passage in r.text for r in sorted((r for r in out if r.doc_id is not None and r.doc_id < 30 and r.doc_id % 3 == 0), key=lambda r: r.doc_id)] == [True] + [False] * 9
    assert next(r.text for r in out if r.doc_id == 7) == rows[7][1]


def brute_fingerprint(text):
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not tokens:
        return 0
    hashed = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + 3]), 42) for i in range(max(1, len(tokens) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_passages_are_found_wherever_they_start(spark, docs_of):
    rng = random.Random(31)
    rows, missed = [], []
    for k in range(40):
        passage = words(rng, 70)
        for copy in range(2):
            before, after = words(rng, rng.randint(1, 60)), words(rng, rng.randint(1, 60))
            rows.append((2 * k + copy, f"{before} {passage} {after}" if k % 2 else f"Start. {before} {passage} {after}. End."))
        missed.append(passage.split())
    out = {r.doc_id: r.text.split() for r in sp.span_dedup(docs_of(rows)).collect()}
    texts = dict(rows)
    for k, passage in enumerate(missed):
        assert out[2 * k] == texts[2 * k].split()
        left = out[2 * k + 1]
        assert len(texts[2 * k + 1].split()) - len(left) >= 30 and len(set(passage) - set(left)) > 0


def test_long_sentences_are_cut_alike():
    rng = random.Random(32)
    passage = words(rng, 120).split()
    ends = []
    for n in (0, 7, 33):
        head = words(rng, n + 1).split()[:n]
        _, start, stop, _ = sp.units_of([" ".join(head + passage)], sp.Words())
        assert max(stop - start) <= sp.WINDOW + 1 and stop[-1] == n + 120 and (start[1:] == stop[:-1]).all()
        ends.append({e - n for e in stop.tolist() if sp.WINDOW < e - n < 120})
    assert ends[0] == ends[1] == ends[2] and len(ends[0]) >= 10


def test_golay_keys_lose_no_pair():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    flips = rng.integers(0, 64, (2, 3000)).astype(np.uint64)
    b = a ^ (np.uint64(1) << flips[0]) ^ (np.uint64(1) << flips[1])
    (ra, ka), (rb, kb) = sh.golay_keys(a), sh.golay_keys(b)
    assert np.bincount(ra).max() <= 18
    shared = {(r, k) for r, k in zip(ra.tolist(), ka.tolist())} & {(r, k) for r, k in zip(rb.tolist(), kb.tolist())}
    assert {r for r, _ in shared} == set(range(3000))


def test_simhash_equals_brute_force(spark, docs_of):
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randint(0, 60))) for i in range(40)]
    for i in range(40, 110):
        text = rng.choice(rows)[1].split()
        if text and rng.random() < 0.6:
            text[rng.randrange(len(text))] = "zz"
        rows.append((i, " ".join(text).upper() if rng.random() < 0.3 else " ".join(text)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "A\x0bb"), (3, rows[3][1])]
    prints = [brute_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = components(len(rows), links)
    least = {}
    for r, (d, _) in zip(roots, rows):
        least[r] = min(least.get(r, d), d)
    expected = sorted((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots))
    assert sorted(map(tuple, sh.simhash_groups(docs_of(rows, fp="x", component="y")).collect())) == expected


def brute_near(rows):
    """The (id, text) that stay if near copies are told by their shingles alone, over all pairs of different (id, text)."""
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    order = hashes_of({t for _, t in rows})
    units = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, order[r[1]]))
    tokens = [cut(t) for _, t in units]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in tokens]

    links = []
    for a in range(len(units)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if tokens[a] == tokens[b] or shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                links.append((a, b))
    roots = components(len(units), links)
    return [u for k, u in enumerate(units) if roots[k] == k], links


def hashes_of(texts):
    """Which of the texts of one id comes first: the hashes that the operator orders by."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    frame = SparkSession.getActiveSession().createDataFrame([(t,) for t in texts], "t string")
    return {r.t: r.h for r in frame.select("t", F.xxhash64(F.col("t").isNull(), F.col("t")).alias("h")).collect()}


def test_near_copies_equal_brute_force(spark, docs_of):
    rng = random.Random(13)
    base = [words(rng, n) for n in (90, 120, 200, 260)]
    rows = [(i, words(rng, rng.randint(0, 8))) for i in range(8)]
    for i in range(8, 60):
        text = rng.choice(base).split()
        for _ in range(rng.choice((0, 1, 2, 4, 8))):
            text[rng.randrange(len(text))] = rng.choice(("zz", "Zy,"))
        rows.append((i, " ".join(text)))
    rows += [(70, None), (71, ""), (72, " .\n"), (None, rows[9][1]), (None, "only here, without an id"), (9, rows[9][1]), (9, words(rng, 30)), (3, rows[9][1].upper()), (80, "x " * 30_000)]
    expected, links = brute_near(rows)
    assert len(links) > 60 and len(expected) < 40
    outs = []
    for block in (512, 5):
        out = sh.simhash_dedup(docs_of(rows, fp="x", k1="y", K2="z"), block=block)
        assert out.columns == docs_of([], fp="x", k1="y", K2="z").columns
        outs.append({(r.doc_id, r.text) for r in out.collect()})
    # what shingles alone keep is kept, and nearly all that they let go goes
    assert outs[0] == outs[1] and outs[0] >= set(expected)
    assert len(set(rows) - outs[0]) >= 0.9 * (len(set(rows)) - len(expected))
    three = [(1, base[0]), (3, base[0]), (3, base[1])]
    assert sorted(tuple(r)[:2] for r in sh.simhash_dedup(docs_of(three)).collect()) == [(1, base[0]), (3, base[1])]


def test_recall_of_near_copies(spark, docs_of):
    """Pairs of four fifths shared shingles and a bit more, of texts of all lengths, each copied once: nine tenths and more are found."""
    rng = random.Random(29)
    rows = []
    for i in range(250):
        text = words(rng, rng.randint(40, 400)).split()
        other = list(text)
        for _ in range(max(1, len(text) // 50)):
            other[rng.randrange(len(other))] = words(rng, 1)
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    expected, _ = brute_near(rows)
    assert 250 <= len(expected) < 400
    kept = {(r.doc_id, r.text) for r in sh.simhash_dedup(docs_of(rows)).collect()}
    assert kept >= set(expected) and len(rows) - len(kept) >= 0.9 * (len(rows) - len(expected))


def test_pair_keys_lose_no_pair_within_five_bits():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000, dtype=np.uint64)
    b = a.copy()
    for _ in range(5):
        b ^= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    (ra, ka), (rb, kb) = sh.pair_keys(a), sh.pair_keys(b)
    assert np.bincount(ra).max() <= 108
    assert {r for r, _ in {*zip(ra.tolist(), ka.tolist())} & {*zip(rb.tolist(), kb.tolist())}} == set(range(2000))


def test_large_buckets_are_paired_in_blocks(spark):
    from snaplake.llm.common import bucket_pairs, connected_components

    rng = np.random.default_rng(5)
    rows = [(int(k), int(i), int(s)) for i, (k, s) in enumerate(zip(rng.integers(0, 4, 900), rng.integers(0, 1 << 16, 900)))]
    rows += [(0, r[1], r[2]) for r in rows[:400]]
    near = lambda left, right: np.bitwise_count((left[:, 0] ^ right[:, 0]).view(np.uint64)) <= 2
    entries = spark.createDataFrame(rows, "key long, id long, sig long").repartition(3)
    expected = {(a, b) for k in range(4) for a, s in {(i, s) for kk, i, s in rows if kk == k} for b, t in {(i, s) for kk, i, s in rows if kk == k} if a < b and (s ^ t).bit_count() <= 2}
    got = {(min(r), max(r)) for r in map(tuple, bucket_pairs(entries, near, False, block=50).collect())}
    assert got == expected and len(got) > 50
    parts = [sorted(map(tuple, connected_components(bucket_pairs(entries, near, True, block)).collect())) for block in (7, 5000)]
    assert parts[0] == parts[1]


def brute_contained(rows, items):
    def shingles(t, n):
        w = re.findall(r"\w+", (t or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    out = []
    for d, t in rows:
        for i, x in set(items):
            n = min(5, len(re.findall(r"\w+", (x or "").lower())))
            s = shingles(x, n)
            n = len(s & shingles(t, n))
            if s and n >= 0.8 * len(s) - 1e-9:
                out.append((d, i, n, len(s)))
    return out


def test_containment_equals_brute_force(spark, docs_of, monkeypatch):
    rng = random.Random(12)
    items = [(i, words(rng, rng.choice((0, 1, 3, 5, 8, 30, 60)))) for i in range(25)] + [(25, None), (3, "again one more item text here")]
    rows = []
    for i in range(60):
        text = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            if text:
                text[rng.randrange(len(text))] = "zz"
        rows.append((i, words(rng, rng.randint(0, 400)) + "! " + " ".join(text).upper() + "\n" + words(rng, 5)))
    rows += [(70, None), (71, ""), (5, rows[5][1]), (None, rows[6][1])]
    order = lambda x: sorted(x, key=str)
    docs, bench = docs_of(rows, item_id="x"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_contained(rows, items)
    for size in (1_000_000, 100):
        monkeypatch.setattr(dec, "BLOCK_SHINGLES", size)
        got = dec.contained_items(docs, bench)
        assert order((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got.collect()) == order(expected)
    clean = dec.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert order((r.doc_id, r.text) for r in clean.collect()) == order((d, t) for d, t in rows if (d, t) not in {(d, dict(rows)[d]) for d, *_ in expected})
    assert dec.contained_items(docs_of([]), bench).count() == 0 and dec.contained_items(docs, bench.limit(0)).count() == 0
    assert dec.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_short_items_are_found_inside_long_texts(spark, docs_of):
    docs = docs_of([(1, "well the quick brown fox jumps over it"), (2, "Quick, brown\tFOX"), (3, "quick fox brown"), (4, "brown"), (5, ""), (6, None)])
    bench = spark.createDataFrame([(7, "quick brown fox"), (8, "brown"), (9, "brown fox jumps over"), (10, "...")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.contained_items(docs, bench).collect()}
    assert got == {(1, 7), (1, 8), (1, 9), (2, 7), (2, 8), (3, 8), (4, 8)}
    assert {r.doc_id for r in dec.decontaminate(docs, bench).collect()} == {5, 6}


def python_steps(df):
    """The Python steps that a task of df's plan runs at once, at most."""
    most = []

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        below = [walk(plan.children().apply(k)) for k in range(plan.children().size())]
        most.append((max if name == "Union" else sum)(below or [0]) + name.startswith("MapInArrow"))
        return 0 if "Exchange" in name else most[-1]

    walk(df._jdf.queryExecution().executedPlan())
    return max(most)


def test_tasks_that_find_links_take_one_python_worker(spark, docs_of, monkeypatch):
    from snaplake.llm import common

    seen, write = [], common.durable
    for module in (common, ld, sh):
        monkeypatch.setattr(module, "durable", lambda df: seen.append(python_steps(df)) or write(df))
    rng = random.Random(13)
    stems = [words(rng, 12) for _ in range(12)]
    docs = docs_of([(k, mutate(rng, stems[k % 12], 1)) for k in range(48)])
    lines = ld.lines_of(docs, "doc_id", "text")
    for block in (2, 256):
        assert common.connected_components(ld.line_links(lines, block=block), folded=True).count() > 12
    assert sh.simhash_dedup(docs, words=2, least=0.5, block=2).count() < 48
    assert sh.simhash_groups(docs).count() == 48
    entries = spark.createDataFrame([(k % 2, k, k % 3) for k in range(40)], "key long, id long, sig long")
    found = common.bucket_pairs(entries, lambda left, right: left[:, 0] == right[:, 0], True, block=7)
    assert common.connected_components(found, folded=True).count() == 34
    assert max(seen) == 1 and len(seen) > 10
