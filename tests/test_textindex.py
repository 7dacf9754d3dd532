"""The stored index gives the scores of the scan, reads few rows for rare words, and skips blocks for the best."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_scale import records_read

from snaplake.operators import search, textindex


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(3000)]
    rows = [(3 * i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) + (" Rareword" if i == 700 else ""), rng.choice(["Alpha beta", "beta", None])) for i in range(1500)]
    return spark.createDataFrame(rows + [(9001, None, None), (9002, "", ""), (None, "w1", "beta")], "doc_id long, text string, more string").repartition(4)


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    textindex.build(docs, "doc_id", ["text", "more"], folder, block=16)
    return folder


def scores(frame):
    return {r.id: pytest.approx(r.score, abs=1e-9) for r in frame.collect()}


@pytest.mark.parametrize("query,prefix", [("w1 w2 W77", False), ("rareword", False), ("w5 w12", True), ("no such", False), ("", False), ("w1", True)])
def test_scores_equal_the_scan(spark, docs, index, query, prefix):
    known = docs.where("doc_id is not null")
    got = textindex.search(spark, index, query, ["text"], last_as_prefix=prefix)
    assert scores(got) == {r.id: r.score for r in search.bm25(known, "doc_id", "text", query, last_as_prefix=prefix).collect()}


def test_two_fields_add_up(spark, docs, index):
    known = docs.where("doc_id is not null")
    parts = [search.bm25(known, "doc_id", c, "w3 beta") for c in ("text", "more")]
    expected = parts[0].unionAll(parts[1]).groupBy("id").agg(F.sum("score").alias("score"))
    assert scores(textindex.search(spark, index, "w3 beta")) == {r.id: r.score for r in expected.collect()}


@pytest.mark.parametrize("query", ["w1", "w1 w2 w3", "rareword w1", "w40"])
@pytest.mark.parametrize("k", [1, 7, 5000])
def test_the_best_equal_those_of_the_scan(spark, docs, index, query, k):
    got = [(r.id, round(r.score, 9)) for r in textindex.search(spark, index, query, ["text"], k=k).collect()]
    best = search.top(search.bm25(docs.where("doc_id is not null"), "doc_id", "text", query), k)
    assert got == [(r.id, round(r.score, 9)) for r in best.collect()]


def test_few_rows_are_read(spark, docs, tmp_path):
    """A rare word costs a page of blocks; for the best of a frequent one most blocks stay unread."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), F.when(F.col("id") % 1000 == 5, "common common ").otherwise(F.lit("")), F.lit("u"), F.col("id")).alias("text"))
    folder = str(tmp_path / "index")
    textindex.build(rows, "doc_id", ["text"], folder, block=16)
    blocks = spark.read.parquet(f"{folder}/blocks")
    total = blocks.count()
    found, read = records_read(spark, lambda: textindex.search(spark, folder, "u777").collect())
    assert [r.id for r in found] == [777] and read < 3_000 < total / 10
    taken = []
    weights = blocks.where("term = 'common'").groupBy("field", "term").agg(F.sum("n").alias("df"), F.max("best").alias("most")).withColumns({"n_docs": F.lit(60_000), "mean_len": F.lit(2.0), "idf": F.lit(1.0)})
    scored = lambda chosen: textindex._decoded(chosen).groupBy("id").agg(F.sum(textindex._part(F.col("tf"), F.col("len"), F.lit(2.002))).alias("score"))
    taken = textindex._worth_reading(blocks.where("term = 'common'"), weights, scored, 10).count()
    assert taken < 200 < blocks.where("term = 'common'").count() / 10


def test_runs_hold_many_postings_a_row_and_blocks_are_theirs(monkeypatch):
    """What is shuffled is a row for each term of some documents, not for each posting; cut anywhere, blocks hold every posting once, full but for a term's last."""
    rng = random.Random(1)
    monkeypatch.setattr(textindex, "WORDS", 4_000)
    monkeypatch.setattr(textindex, "RUN", 20)
    docs = [(i, f, [f"w{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randrange(0, 30))]) for i in range(400) for f in "ab"] + [(999, "a", []), (1000, "b", ["é", "z", "é"])]
    wanted = {(f, x, i): (w.count(x), len(w)) for i, f, w in docs for x in set(w)}
    batch = pa.record_batch([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs]), pa.array([d[2] for d in docs], pa.list_(pa.string()))], names=["id", "f", "w"])
    runs = [r for b in textindex._runs([batch.slice(0, 500), batch.slice(500, 0), batch.slice(500)]) for r in b.to_pylist()]
    facts = [r for r in runs if not r["term"]]
    assert (sum(r["n"] for r in facts), sum(r["words"] for r in facts)) == (len(docs), sum(len(w) for _, _, w in docs))
    runs = sorted((r for r in runs if r["term"]), key=lambda r: (r["field"], r["term"].encode(), r["first"]))
    assert len(runs) < len(wanted) / 4 and max(r["n"] for r in runs) == 20
    schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("postings", pa.binary())])
    means = {"a": 10.0, "b": 12.0}
    for step in (7, 50, 10_000):
        cut = [pa.RecordBatch.from_pylist(runs[i : i + step], schema=schema) for i in range(0, len(runs), step)]
        got, short = {}, []
        for r in (r for b in textindex._blocks(means, 16)(cut) for r in b.to_pylist()):
            ids = [r["first"] + x for x in itertools.accumulate(r["gaps"])]
            assert ids == sorted(set(ids)) and ids[-1] == r["last"] and len(ids) == r["n"] <= 16
            assert r["best"] == pytest.approx(max(textindex._part(c, n, means[r["field"]]) for c, n in zip(r["counts"], r["lengths"])))
            assert not got.keys() & {(r["field"], r["term"], i) for i in ids}
            got |= {(r["field"], r["term"], i): (c, n) for i, c, n in zip(ids, r["counts"], r["lengths"])}
            short += [(r["field"], r["term"])] if r["n"] < 16 else []
        assert got == wanted and len(short) == len(set(short))
