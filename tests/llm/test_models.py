"""Embedding links, quality, tokens, shards, archives and pages."""

import base64
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from snaplake.llm import bpe, embeddings, htmltext, quality, sharding, sql, warc
from snaplake.llm.common import connected_components
from snaplake.llm.queries import queries, vocabulary_path


def test_components_by_distributed_rounds(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(16)
    assert sorted(map(tuple, connected_components(frame, finish=10).collect())) == sorted(map(tuple, connected_components(frame).collect()))


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, label_2 string")


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * rng.choice((0.0, 0.1, 0.25, 0.4))
        rows.append([i, [float(x) for x in v], int(i % 3), "x"])
    rows += [[500, None, 1, "x"], [501, [0.0] * 16, 1, "x"], [502, [float("nan")] * 16, 1, "x"], [503, [None] * 16, 1, "x"], [504, rows[0][1], None, "x"], [505, rows[0][1], 0, "x"], [7, rows[7][1], 1, "x"], [None, rows[0][1], 0, "x"]]
    by = {r[0]: r for r in rows if r[0] is not None}
    good = [i for i, r in by.items() if r[1] is not None and r[2] is not None and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1])]
    unit = {i: (v := np.array(np.float32(by[i][1]), float)) / np.linalg.norm(v) for i in good}
    links = {i: [j for j in good if j != i and by[i][2] == by[j][2] and unit[i] @ unit[j] >= 0.93] for i in by if True and i in good}
    got = {r.vec_id: r for r in embeddings.near_vectors(vectors_table(spark, rows)).collect()}
    assert set(got) == set(by)
    found, there = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert there > 500 and 0.97 * there <= found <= there
    assert all(got[i].n_links <= len(links.get(i, ())) for i in by)
    assert all(got[i].n_links == 0 and got[i].kept for i in (500, 501, 502, 503, 504))
    small = embeddings.nodes_of(vectors_table(spark, rows), "vec_id", "embedding", "label").where("unit is not null and label is not null and vec_id is not null").withColumnRenamed("vec_id", "node").dropDuplicates(["node"])
    pairs = embeddings.vector_links(small, shard=12).collect()
    assert {(r.a, r.b) for r in pairs} <= {(i, j) for i, x in links.items() for j in x}
    assert len(pairs) >= 0.9 * there / 2
    assert embeddings.near_vectors(vectors_table(spark, [])).count() == 0


def test_embedding_recall_and_oracle(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = embeddings.near_vectors(rows)
    assert embeddings.audit(rows, out, every_nth=1).first().recall >= 0.9
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    expected = con.execute(sql.ORACLES["op3_embedding_links"]).fetchall()
    assert sorted(map(tuple, out.select("vec_id", "n_links", "component_id", "kept").collect())) == sorted(expected)


def planted(rng, groups, alone, width=64, labels=3):
    """Vectors in groups whose members are some 0.9 to 0.99 alike, others alone."""
    rows = []
    for g in range(groups):
        base = rng.normal(size=width)
        for _ in range(int(rng.integers(2, 12))):
            rows.append(((base + rng.normal(size=width) * rng.uniform(0.1, 0.3)).tolist(), g % labels))
    rows += [(rng.normal(size=width).tolist(), int(rng.integers(0, labels))) for _ in range(alone)]
    order = rng.permutation(len(rows))
    return [(int(i), *rows[k], "x") for i, k in enumerate(order)]


def test_recall_where_there_are_links(spark):
    rows = planted(np.random.default_rng(21), 900, 3_000)
    frame = vectors_table(spark, rows).repartition(4)
    out = embeddings.near_vectors(frame).cache()
    checked = embeddings.audit(frame, out, every_nth=1).first()
    assert checked.there > 4_000 and 0.9 <= checked.recall <= 1
    unit = np.array([r[1] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    links = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    assert checked.there == links.sum() - len(rows)
    every = embeddings.audit(frame, out, every_nth=50, block=100).first()
    assert every.there == (links.sum(axis=1) - 1)[::50].sum()


def test_shards_are_cut_again_where_centres_are_few(spark):
    rng = np.random.default_rng(22)
    rows = planted(rng, 200, 700, width=16, labels=1)
    base = rng.normal(size=16)
    rows += [(10_000 + i, (base + rng.normal(size=16) * 0.08).tolist(), 0, "x") for i in range(150)]  # a dense group larger than a shard
    frame = vectors_table(spark, rows).repartition(4)
    out = embeddings.near_vectors(frame, shard=12, overlap=3, most=4).cache()
    checked = embeddings.audit(frame, out, every_nth=1).first()
    assert checked.there > 15_000 and 0.9 <= checked.recall <= 1
    nodes = embeddings.nodes_of(frame, "vec_id", "embedding", "label").withColumnRenamed("vec_id", "node")
    sizes = embeddings.shards_of(nodes, 0.93, 12, 3, 4).groupBy("place", "part").count().collect()
    assert max(r["count"] for r in sizes) <= 4 * 12 * 2 and any("." in r.place for r in sizes) and any(r.place.endswith("|") for r in sizes)


def test_links_at_the_threshold(spark):
    a, b = [1.0, 0.0], [0.93, (1 - 0.93**2) ** 0.5]
    rows = [(1, a, 0, "x"), (2, b, 0, "x"), (3, [0.929, (1 - 0.929**2) ** 0.5], 0, "x")]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, label_2 string")
    unit = np.array([r[1] for r in rows])
    unit /= np.abs(unit).max(axis=1)[:, None]
    unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
    links = [[j for j in range(3) if j != i and (unit[i] * unit[j]).sum() >= 0.93] for i in range(3)]
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(wide).collect()}
    assert got == {i + 1: len(x) for i, x in enumerate(links)}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries()["op7_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    pos, neg = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert auc > 0.9
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def test_rules_compile_to_the_same_scores(spark, docs_of):
    rng = np.random.default_rng(4)
    names = list(quality.features())
    x = rng.normal(size=(600, len(names)))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    model = quality.RuleEnsemble(x, y, names)
    assert 0 < len(model.rules) < 120
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], names)
    got = [r[0] for r in frame.select(model.column()).collect()]
    assert np.allclose(sorted(got), sorted(model.scores(x[:50])))


def brute_features(text):
    """The statistics of a text by plain Python; regex has the same character classes."""
    import regex

    words, lines = text.split(), text.split("\n")
    solid = sum(len(w) for w in words)
    other = regex.sub(r"[\p{L}\s]+", "", text)
    per = lambda a, b: a / max(b, 1)
    n = len(words)
    plain = [c for c in other if not ("0" <= c <= "9") and c not in ".,;:!?'\"()-"]
    return {
        "word_count": n,
        "word_length": per(solid, n),
        "upper_share": per(len(regex.findall(r"\p{Lu}", text)), solid),
        "other_share": per(len(other), solid),
        "symbol_share": per(len(plain), solid),
        "digit_share": per(sum("0" <= c <= "9" for c in other), solid),
        "shout_share": per(text.count("!"), n),
        "distinct_share": per(len(set(words)), n),
        "short_share": per(sum(len(w) <= 3 for w in words), n),
        "stop_share": per(len(regex.findall(r"[.!?](?=\s|$)", text)), n),
        "line_words": per(n, len(lines)),
        "distinct_lines": per(len(set(lines)), len(lines)),
        "longest_word": max(map(len, words), default=0),
    }


def test_statistics_equal_brute_force(spark, docs_of):
    rng = random.Random(14)
    texts = ["", " ", "A", "a.b. c!", "!!!", "One. Two? THREE!! 4,5 (six) - x", "line\nline\n\nother", "ünïcödé ÄÖÜ 北京 🙂", "x" * 100_000, "w " * 20_000]
    texts += ["".join(rng.choice("aB é.!?1 $\n\t-") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    docs = docs_of([*enumerate(texts), (900, None)])
    names = list(quality.features())
    for r in quality.with_features(docs, "text", [docs.doc_id, docs.text]).select("doc_id", "text", *names).collect():
        expected = brute_features(r.text or "")
        assert all(abs(r[n] - expected[n]) < 1e-12 for n in names), (r.doc_id, r.text)


def test_the_least_text_of_a_repeated_id_is_learned_from(spark, docs_of):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    text = lambda i: "good words stand here. " * 3 if i % 2 else "BAD!! " * 9
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    plain = quality.fit(docs_of([(i, text(i)) for i in ids]), labels)
    repeated = quality.fit(docs_of([(i, text(i)) for i in ids] + [(i, "z later " * 50) for i in ids]), labels)
    assert plain.rules == repeated.rules and np.allclose(plain.weights, repeated.weights)


def test_a_score_at_the_border_is_accepted(spark, docs_of):
    class Fixed:
        def __init__(self, score):
            self.score = score

        def column(self):
            from pyspark.sql import functions as F

            return F.lit(self.score)

    docs = docs_of([(1, "a")], _row="x", words="y")
    assert [quality.quality_scores(docs, Fixed(s)).first().predicted for s in (0.3, 0.29999999)] == [1, 0]
    assert quality.quality_filter(docs, Fixed(0.3)).collect() == docs.collect() and quality.quality_filter(docs, Fixed(0.29999999)).count() == 0


def test_quality_edges(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 200_000)], score="s", words="w")
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.quality_scores(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_filter(docs, model).columns == docs.columns
    assert quality.quality_scores(docs_of([]), model).count() == 0


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_bpe_equals_the_library(spark, docs_of):
    rng = random.Random(3)
    texts = ["", " ", "a", "  two  spaces \n\n tabs\t\t", "it's we'll I'M 'tis", "naïve ß 北京 🙂🙂 ́", "<|endoftext|>x<|endoftext|>", "a\xa0b c\x85d", "x" * 5000, "1234567 89,0%%%***", "\u0000\u0001", "the " * 3000]
    texts += ["".join(rng.choice("etaoin") for _ in range(n)) for n in (*range(bpe._SCANNED - 2, bpe._SCANNED + 3), 700)]  # merged by scans and by the heap
    texts += ["".join(rng.choice("ab é'\n\t .!19<|日🙂") for _ in range(rng.randint(1, 90))) for _ in range(150)]
    docs = docs_of([*enumerate(texts), (900, None), (1, texts[1])], ids="x", decoded="y")
    t = tokenizer()
    t.no_truncation()
    t.no_padding()
    got = sorted(map(tuple, bpe.bpe_digests(docs, vocabulary_path()).collect()))

    def line(i, text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert got == sorted(line(i, x) for i, x in [*enumerate(texts), (900, None), (1, texts[1])])
    assert bpe.bpe_encode(docs, vocabulary_path()).columns == ["doc_id", "ids", "lang", "source", "n_chars", "decoded"]
    assert bpe.bpe_digests(docs_of([]), vocabulary_path()).count() == 0


def test_shards_are_balanced_and_keep_groups(spark, docs_of):
    rng = random.Random(4)
    rows = [(i, "é" * rng.randint(0, 50) + str(i)) for i in range(1500)] + [(2000 + i, "hot text") for i in range(1900)] + [(4000, None), (4001, ""), (4000, None), (None, "no id")]
    rows += [(5000 + i, f"group {i % 7}" * 9) for i in range(200)] + [(6000, "long " * 900), (6001, "long " * 900)] + [(7000 + i, f"pair {i // 2}") for i in range(300)]
    rng.shuffle(rows)
    out = sharding.shard_by_bytes(docs_of(rows, group="x", part="y", large="z").repartition(6), shards=8).collect()
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(i), len((t or "").encode()) + 16) for i, t in rows)
    sizes = [sum(r.size for r in out if r.shard == k) for k in range(8)]
    target = sum(sizes) / 8
    assert max(sizes) - target <= 0.02 * target + 9_000 and target - min(sizes) <= 0.02 * target + 9_000
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))
    crc = {str(i): zlib.crc32((t or "").encode()) for i, t in rows}
    assert all(r.text_crc32 == crc[str(r.doc_id)] for r in out)
    where, weight = {}, {}
    for r in out:
        where.setdefault(r.text_crc32, set()).add(r.shard)
        weight[r.text_crc32] = weight.get(r.text_crc32, 0) + r.size
    cut = [c for c, x in where.items() if len(x) > 1]
    assert cut == [zlib.crc32(b"hot text")] and weight[cut[0]] > target and len(where[cut[0]]) == -(-weight[cut[0]] // target)
    assert sharding.shard_by_bytes(docs_of([]), shards=8).count() == 0
    assert [r.slot for r in sharding.shard_by_bytes(docs_of([(1, "only")]), shards=8).collect()] == [0]


def test_large_groups_are_cut_only_for_want_of_room():
    rng = random.Random(5)
    for _ in range(200):
        shards, groups = rng.randint(1, 12), [(bytes([k]), rng.randint(1, 40), rng.randint(1, 30)) for k in range(rng.randint(0, 20))]
        total = sum(n * s for _, n, s in groups) + rng.randint(0, 4000)
        places, room = sharding.placed_groups(groups, total, shards)
        assert sum(room) == total - sum(n * s for _, n, s in groups)
        assert all(sum(x for _, x in places[k]) == n and all(x > 0 for _, x in places[k]) for k, n, _ in groups)
        assert all(len(places[k]) == 1 for k, n, s in groups if shards == 1 or n * s <= total / shards / 2 - 30 and all(m * t <= total / shards / 2 for _, m, t in groups))
        assert min(room) >= -max([s for *_, s in groups], default=0)


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"http://h{i}.example/ x", rng.choice(["", "é\r\n\r\nWARC/1.1\r\n0\r\n\r\n" * 40, f"<p>{i}</p>" * rng.randint(1, 400), "same"])) for i in range(120)]
    rows += [(200, None, None), (None, "u", "x"), (None, "u", "x"), (None, "v", "x"), (3, rows[3][1], rows[3][2]), (4, "other", rows[3][2]), (3, rows[3][1], "another payload"), (300, "long", "z" * 50_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    least = lambda i: -1 if i is None else i
    order = sorted(rows, key=lambda r: (least(r[0]), r[1] or ""))
    last = {}
    for i, _, h in order:
        last[h or ""] = i
    expected, done = [], set()
    for i, _, h in reversed(order):
        p = (h or "").encode()
        first = p not in done
        done.add(p)
        expected.append((i, "response" if first else "revisit", len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), None if first else last[h or ""]))
    for compression in ("gzip", "none"):
        out = warc.archived(pages, str(tmp_path / compression), segment=700, chunk=64, file_bytes=3_000, compression=compression).collect()
        assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(expected, key=str)
        assert len({r.record_id for r in out}) == len(rows)
        assert all(f.stat().st_size < 3_900 for f in (tmp_path / compression).iterdir())
    texts = warc.read_archives(spark, str(tmp_path / "gzip")).where("record_type = 'response'").collect()
    assert {bytes(r.payload): r.page_id for r in texts} == {h.encode(): i for h, i in last.items()}
    short = warc.archived(pages, least_bytes=5).collect()
    assert sum(r.record_type == "response" for r in short) == len(last) - 3 + sum((h or "") in ("", "same", "x") for *_, h in rows) and len({r.record_id for r in short}) == len(rows)
    assert warc.archived(pages.limit(0), str(tmp_path / "none at all")).count() == 0


def test_damaged_archives_are_refused():
    record = warc.page_records(1, "u", b"x" * 300, None)[0] + b"\r\n"
    assert len(list(warc.parse(record * 2))) == 2
    with pytest.raises(ValueError):
        list(warc.parse(record[:-9]))
    with pytest.raises(ValueError):
        warc.unchunked(warc.chunked(b"abcdef", 3)[:-8])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header class="site">Top</header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p>One <b>bold</b>
 text<br>more<p>Two&nbsp;&#233; &lt;i&gt;<aside>Side</aside><form><input>Form</form><div class="comments"><p>First!</div><ul><li>x<li>y</ul><!-- gone --></article>
<section id="comment-list"><p>Reader</p></section><footer>&copy; host</footer></body></html>"""


def test_marked_articles(spark):
    pages = spark.createDataFrame([(1, "http://a.example/1", PAGE, "c"), (2, None, None, "c"), (3, "x", "", "c"), (4, "http://b.example", "<p>a<p>b &amp;amp; c", "c"), (5, "u", "<article><p>cut off <b>here", "c"), (1, "http://a.example/1", PAGE, "c"), (None, "http://a.example/2", "plain &lt; text", "c")], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.main_text(pages).collect()}
    text = "Head & line\nOne bold text more\nTwo é <i>\nx\ny"
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), 4: ("a\nb &amp; c", 11), 5: ("cut off here", 12), None: ("plain < text", 12)}
    assert htmltext.main_text(pages.limit(0)).count() == 0


def say(rng, n):
    return " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(n))


def brute_main_text(rows):
    """Main texts by their definition: runs of six words as tuples, pages of a host by signature."""
    from urllib.parse import urlsplit

    seen, pages = {}, []
    for i, url, page in rows:
        texts, kinds = htmltext.blocks(page or "")
        words, sizes = htmltext.word_hashes(texts)
        host, sign = urlsplit(url or "").hostname or "", htmltext.signature(words, sizes, kinds)
        flat = [w for t in texts for w in t.lower().split()]
        pages.append((i, host, texts, kinds, sizes, flat))
        if flat:
            seen.setdefault((host,), set()).add(sign)
        for k in range(len(flat) - 5):
            seen.setdefault((host, *flat[k : k + 6]), set()).add(sign)
    out = []
    for i, host, texts, kinds, sizes, flat in pages:
        def gone(least):
            covered = [any(len(seen[host, *flat[j : j + 6]]) >= least for j in range(max(0, k - 5), min(k + 1, len(flat) - 5))) for k in range(len(flat))]
            ends = np.cumsum(sizes).tolist()
            return [sum(covered[e - n : e]) >= 0.6 * n for e, n in zip(ends, sizes)]

        loose, strict = gone(3), gone(max(5, 0.5 * len(seen.get((host,), ()))))
        marked = [k for k in range(len(texts)) if kinds[k] == htmltext.MARKED and not strict[k]] or [k for k in range(len(texts)) if kinds[k] == htmltext.MARKED]
        free = [k for k in range(len(texts)) if kinds[k] == htmltext.OPEN and not loose[k]]
        chosen = marked or free or [k for k in range(len(texts)) if kinds[k] == htmltext.OPEN]
        out.append((i, "\n".join(texts[k] for k in chosen)))
    return out


@pytest.fixture(scope="module")
def site():
    """Pages of three hosts: menus and legal text in plain blocks, a box within every article, copies, near copies and quotes."""
    rng = random.Random(8)
    menu, legal, box, quote, licence = say(rng, 9), say(rng, 20), say(rng, 14), say(rng, 30), say(rng, 25)
    rows = []
    for i in range(40):
        own = [say(rng, 30), say(rng, 25)]
        if i % 4 == 0:
            own.append(quote)
        rows.append((i, f"https://user@Big.example:80/{i}", f"<div>{menu}</div><article><h1>{say(rng, 7)}</h1><p>{own[0]}</p><div>{box}</div>" + "".join(f"<p>{x}</p>" for x in own[1:]) + f"</article><div>{legal}</div>"))
        rows.append((100 + i, f"https://plain.example/{i}", f"<div>{menu}</div><div><span>{own[0]}</span></div><div>{licence if i in (3, 9) else own[1]}</div><div>{legal}</div>"))
    whole = say(rng, 60).split()
    for i in range(6):  # copies with one word changed
        words = list(whole)
        words[10 * i] = "zz"
        rows.append((200 + i, f"https://copies.example/{i}", f"<p>{' '.join(words[:30])}</p><p>{' '.join(words[30:])}</p>"))
    rows += [(300, "https://big.example/teaser", f"<article>{say(rng, 5)}</article><div>{say(rng, 40)}</div>"), (0, *rows[0][1:]), (301, None, None), (302, "", ""), (303, "https://big.example/long", f"<p>{say(rng, 20_000)}</p>")]
    return rows, {"menu": menu, "legal": legal, "box": box, "quote": quote, "licence": licence}


def test_main_text_equals_brute_force(spark, site):
    rows, parts = site
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, host string, row string").repartition(5)
    expected = sorted(brute_main_text(rows))
    for shard_bytes, most, hot in ((4_000_000, 1_000_000, None), (3_000, 1_000_000, 4), (3_000, 0, None)):
        got = htmltext.main_text(pages, shard_bytes=shard_bytes, broadcast_runs=most, hot=hot).collect()
        assert sorted((r.page_id, r.text) for r in got) == expected
    by = dict(expected)
    for i in range(40):
        assert not any(parts[x] in by[i] for x in ("menu", "legal", "box")) and (i % 4 > 0 or parts["quote"] in by[i])
        assert not any(parts[x] in by[100 + i] for x in ("menu", "legal"))
    assert parts["licence"] in by[103] and parts["licence"] in by[109]
    assert all(len(by[200 + i].split()) == 60 for i in range(6)) and len(by[300].split()) == 5


def test_the_suffix_array_decides(spark, site):
    rows, _ = site
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    by_markup = {r.page_id: r.text for r in htmltext.main_text(pages, least_pages=1_000_000, widely=1_000_000).collect()}
    assert sum(text != by_markup[i] for i, text in brute_main_text(rows)) >= 80


def test_names_that_mark_and_names_that_do_not():
    page = """<main><header class="entry-header"><h1>Title</h1></header><p class="ad-hoc">One</p><div class="share-price">Two</div><div id="search-engine-history">Three</div>
    <div class="share-buttons">no</div><div class="commentList">no</div><section id="related-posts">no</section><div class="ad">no</div><footer class="x">no</footer></main><header class="site-header">no</header>"""
    assert [t for t, k in zip(*htmltext.blocks(page)) if k == htmltext.MARKED] == ["Title", "One", "Two", "Three"]


def test_malformed_pages_take_linear_time():
    import time

    n = 100_000
    began = time.perf_counter()
    for page in ("<div" * n, '<div a="' * n, '<a b=">"' * n, "<a b='" * n + ">", "<svg>" * n, "<!--" * n, "<div>" * n + "</span>" * n, "<span><article>" + "<div>" * n + "</span>" * n, "&#" + "1" * n, "<div " + "class  " * n + ">x", "<" * n, "<a" + " " * n, "<script>" * n, "<![CDATA[" * n, "<p>" * n):
        htmltext.blocks(page)
    assert time.perf_counter() - began < 60
    assert htmltext.blocks("a < b &#99999999999; <p>c<div d")[0] == ["a < b \ufffd", "c"]


@pytest.mark.parametrize("hot, shard_bytes", [(None, 4_000_000), (20, 4_000_000), (7, 20_000)])
def test_pages_are_counted_exactly(spark, monkeypatch, hot, shard_bytes):
    """63 pages count as 63, copies once, hosts apart; however runs are dealt."""
    monkeypatch.setattr(htmltext, "FILTER_BITS", 12)  # the bitmap lets nearly all through
    rng = random.Random(5)
    sizes, rows = {"a": 63, "b": 5, "c": 4, "d": 700}, []
    lines = {h: say(rng, 6) for h in sizes}
    for h, n in sizes.items():
        rows += [(h, f"<nav>{lines[h]}</nav><p>{say(rng, 12)}</p>") for _ in range(n)]
    rows += rows[:40] * 3 + [("e", f"<nav>{lines['a']}</nav>")]
    found = htmltext.repeated_runs(spark.createDataFrame(rows, "host string, html string").repartition(6), 6, 4, shard_bytes, hot)
    hashed = {h: np.uint64(xxhash.xxh64_intdigest(h.encode())) for h in sizes}
    words = {h: htmltext.word_hashes([lines[h]])[0] for h in sizes}
    named = {}
    for h, n in sizes.items():
        host = np.full(6, hashed[h], np.uint64)
        named[int(htmltext.run_hashes(words[h], host)[0])] = n
        named[int(htmltext.host_run(host[:1])[0])] = n
    got = {r.h % (1 << 64): r.n for r in found.collect()}
    assert got == named


def test_texts_by_hand(spark):
    """What a reader would take from these pages, written down; one page is judged alike on a small and on a large host."""
    rng = random.Random(6)
    notice = "All of our prices are shown with tax and without shipping"
    own = [f"Story {i} says {say(rng, 60)}." for i in range(70)]
    pages = [(i, f"http://shop.example/{i}", f"<div>{notice}</div><div>{own[i]}</div><div>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds {i}</div>") for i in range(70)]
    expected = {i: f"{own[i]}\nWhere x=2 holds {i}" for i in range(70)}
    for n in (70, 5):
        got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(pages[:n], "page_id long, url string, html string")).collect()}
        assert got == {i: expected[i] for i in range(n)}
    # in two pages of a host nothing repeats often enough: all blocks stay
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(pages[:2], "page_id long, url string, html string")).collect()}
    assert got == {i: f"{notice}\n{expected[i]}" for i in range(2)}


def test_words_have_a_hash_each():
    texts = ["Ein Wort", "é", "wort ein EIN e\u0301", "x"]
    hashed, sizes = htmltext.word_hashes(texts)
    words = " ".join(texts).lower().split()
    assert sizes.tolist() == [2, 1, 4, 1] and len({*zip(words, hashed.tolist())}) == len(set(words)) == len(set(hashed.tolist()))
    assert htmltext.word_hashes([])[0].tolist() == []


def test_plain_and_other_pages_are_read_alike():
    rng = random.Random(12)
    parts = ["<p>", "</p>", "<div class='ad'>", '<div class="ad">', "</div>", "<b>", "</b>", "text & more ", "<br/>", "<nav>", "</nav>", "<article>", "</article>", "<!-- x -->", "<script>var a='<p>'</script>", "<li>", "</li>", "<ul>", "</ul>", "1 < 2 ", "<img src=x>", "<svg>", "<p class=share>"]
    for _ in range(300):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        as_is, slow = htmltext.blocks(page), None
        quick = htmltext.tags
        htmltext.tags = lambda page: ([], 0)
        try:
            slow = htmltext.blocks(page)
        finally:
            htmltext.tags = quick
        assert as_is == slow, page
