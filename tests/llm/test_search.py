"""Exact top-k search, hard negatives and source divergence against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snaplake.llm.divergence import source_divergence, terms_of
from snaplake.llm.negatives import Mining, hard_negatives
from snaplake.llm.scored import Best
from snaplake.llm.topk import Search, top_products

CLASH = {c: "clash" for c in ("id", "v", "key", "asks", "block", "part", "is_row", "rank", "score", "there", "query_id", "anchor_id", "nth")}


def table(spark, rows):
    schema = "vec_id long, embedding array<double>, label int" + "".join(f", {c} string" for c in CLASH)
    return spark.createDataFrame([(*r, *CLASH.values()) for r in rows], schema).repartition(3)


def rows_of(seed, n, width=24, labels=4, scale=0.3):
    """Vectors around some centres, with ties, invalid ones and other lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    rows = [(i, (centres[i % 9] + rng.normal(size=width) * scale).tolist(), int(rng.integers(0, labels))) for i in range(n)]
    rows += [(n + i, rows[7 * i][1], (rows[7 * i][2] + i) % labels) for i in range(40)]
    rows += [(5000, None, 1), (5050, [float("nan")] * width, 1), (5100, [None, 1.0], 0), (5101, [math.inf] * width, 2), (5150, [], 1), (5151, [1.5], 0), (5152, [0.5] * (width + 9), 1), (None, [1.0] * width, 1), (5200, [1.0] * width, None), (5200, [1.0] * width, None)]
    return rows


def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]


def product(a, b):
    return max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


def brute_top(rows, k, every):
    good = [(i, w) for i, v, _ in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        own = min((w for i, w in good if i == q))
        best = sorted((-product(own, w), i) for i, w in good if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def brute_negatives(rows, every):
    good = [(i, w, lab) for i, v, lab in rows if i is not None and lab is not None and (w := whole(v)) is not None]
    out = []
    for a in sorted({i for i, _, _ in good if i % every == 0}):
        lab, own = min((lab, w) for i, w, lab in good if i == a)
        scored = sorted((-product(own, w), i, lab2) for i, w, lab2 in good if i != a)
        for p, pid in [(-s, i) for s, i, lab2 in scored if lab2 == lab][:5]:
            fit = [(-s, i) for s, i, lab2 in scored if lab2 != lab and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(a, pid, r, i, p, s) for r, (s, i) in enumerate(fit, 1)]
    return out


SIZES = [dict(), dict(per_block=3, per_task=37, least_part=5)]


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("seed,scale", [(1, 0.3), (2, 3.0)])
def test_top_products_equal_brute_force(spark, sizes, seed, scale):
    rows = rows_of(seed, 400, scale=scale)
    got = top_products(table(spark, rows), F.col("vec_id") % 50 == 0, **sizes)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5, 50)


def test_top_products_of_few_large_and_no_rows(spark):
    rows = [(0, [1e30, -3.0], 1), (1, [1e30, 2.0], 1), (2, [-1e30, 2.0], 1), (50, [2.0**40, 1.0], 0), (51, [2.0**21, 1.0], 0), (50, [2.0, 1.0], 0)]
    held = [(i, [max(-1e30, min(1e30, x)) for x in v], lab) for i, v, lab in rows]
    got = top_products(table(spark, rows), F.col("vec_id") % 50 == 0)
    # floor() holds components within the range of a long, products too
    expected = brute_top([(i, [math.copysign(min(abs(x), 2.0**63 / 256), x) for x in v], lab) for i, v, lab in held], 5, 50)
    assert [(r.query_id, r.rank, r.vec_id) for r in got.orderBy("query_id", "rank").collect()] == [x[:3] for x in expected]
    for none in ([], [(1, [1.0], 1)], [(0, [1.0], 1)]):
        assert top_products(table(spark, none), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("seed,scale", [(3, 0.3), (4, 2.0)])
def test_hard_negatives_equal_brute_force(spark, sizes, seed, scale):
    rows = rows_of(seed, 300, scale=scale)
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 20 == 0, **sizes)
    expected = sorted(brute_negatives(rows, 20))
    assert len(expected) > 100 and sorted(map(tuple, got.collect())) == expected


def test_hard_negatives_where_there_are_few(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.0], 1), (3, [0.0, 0.0], 1), (4, [0.0, 0.0], 0), (100, [-1.0, 0.0], 1), (101, [1e25, 1.0], 1)]
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(brute_negatives(rows, 100))
    for none in ([], [(0, [1.0], 1)], [(0, [1.0], None), (1, None, 1)]):
        assert hard_negatives(table(spark, none), F.col("vec_id") % 100 == 0).count() == 0


def batch(vectors, first=0, labels=None):
    n = len(vectors)
    return pa.record_batch([pa.array(range(first, first + n), pa.int64()), pa.array(labels if labels is not None else [0] * n, pa.int64()), pa.array(vectors.tolist(), pa.list_(pa.int64()))], names=["id", "label", "v"])


def test_bounds_leave_most_pairs_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 64)) * 60
    vectors = np.floor(centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 64)) * 8).astype(np.int64)
    search = Search(batch(vectors[:50]), 5)
    for i in range(0, 4000, 500):
        search.add(batch(vectors[i : i + 500], i))
    assert search.scored < 0.2 * search.pairs
    for q in range(50):
        score = vectors @ vectors[q]
        expected = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:5]
        here = search.best.place == q
        assert list(zip((-search.best.score[here]).tolist(), search.best.ids[here].tolist())) == expected


def test_planes_narrow_intervals():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 64)) * 60
    own = rng.integers(0, 30, 3000)
    vectors = np.floor(centres[own] + rng.normal(size=(3000, 64)) * 8).astype(np.int64)
    mining = Mining(batch(vectors[:40], labels=own[:40] % 5), 5, True)
    for i in range(0, 3000, 500):
        mining.add(batch(vectors[i : i + 500], i, own[i : i + 500] % 5))
    planes = [mining.left_by_plane[j] for j in sorted(mining.left_by_plane, reverse=True)]
    assert planes == sorted(planes, reverse=True) and planes[-1] < 0.1 * planes[0] and planes[len(planes) // 2] < planes[0]


def test_best_keeps_ties_by_smaller_id():
    rng = random.Random(7)
    best, every = Best(3, 4), []
    for _ in range(30):
        part = [(rng.randrange(3), rng.randrange(6), rng.randrange(1000)) for _ in range(10)]
        every += part
        best.add(*(np.array(x) for x in zip(*part)))
    for place in range(3):
        here = best.place == place
        assert list(zip(best.score[here].tolist(), best.ids[here].tolist())) == [(s, i) for s, i in sorted(((s, i) for p, s, i in every if p == place), key=lambda x: (-x[0], x[1]))][:4]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, least, ranks):
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in mine for t in set(d[2])).items() if n >= least)
        groups = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        groups[None] = Counter(t for d in mine for t in d[2])
        size = {s: sum(c[t] for t in kept) + 5 * len(kept) for s, c in groups.items()}
        p = {s: {t: 1 + (10**9 * (c[t] + 5)) // size[s] for t in kept} for s, c in groups.items()}
        for s in groups:
            if s is None:
                continue
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o not in (None, s)))
            out += [(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(pairs, 1)]
            terms = sorted((p[None][t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > p[None][t])[:ranks]
            out += [(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(terms, 1)]
    return sorted(out)


def test_source_divergence_equals_brute_force(spark):
    rng = random.Random(8)
    words = ["Apfel", "apfel", "Ärger", "ärger", "naïve", "x1y", "don't", "日本", "é", "E", "\x00a", "b c", "İ"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", "zz", None])) for _ in range(400)]
    rows += [(None, "en", "silent"), ("", "fr", "only"), ("1 2 3", "fr", "other"), (None, None, None)] + [rows[0]] * 3
    frame = spark.createDataFrame([(i, *r, "x", "y", "z") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n string, at string").repartition(4)
    got = sorted(map(tuple, source_divergence(frame, least_docs=12, ranks=7).collect()))
    expected = brute_divergence(rows, 12, 7)
    assert got == expected and {r[2] for r in got} == {"pair", "term"}
    assert ("fr", "only", "pair", "other", 0, 1) in got
    assert source_divergence(frame.limit(0)).count() == 0


def test_terms_of_long_texts():
    text = "Wörter, UND mehr " * 200_000
    assert terms_of(text.encode()) == [t.translate(LOWER).encode() for t in TERM.findall(text)]
