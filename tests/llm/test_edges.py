"""Every operator and stage on rows with nulls, very long texts, ties, repeats, clashing columns, and on none."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from snaplake.llm import bpe, decontaminate, embeddings, htmltext, linededup, quality, sharding, simhash, spans, warc
from snaplake.llm.queries import vocabulary_path

CLASHING = {k: "clash" for k in ("_k1", "_gone", "_spans", "_was", "was_blank", "k1", "k2", "firsts", "gone", "key", "id", "node", "fp", "sig", "h1", "row", "hits", "host", "part", "large", "salt", "shard", "slot", "size", "group", "digest", "apart", "last", "copy", "bucket", "_row", "words", "chars", "item_id", "n_item", "score")}
LONG = " ".join(f"w{i % 9973} end{i % 17}." for i in range(60_000))
ROWS = [(1, "A first line of some length, with words.\nA second line, that is as long as it."), (2, None), (3, ""), (4, " \n\t\n"), (5, LONG), (6, LONG + " more"), (7, "tie"), (8, "tie"), (7, "tie"), (7, "another text under the same id"), (None, "no id here"), (None, None), (-3, "below zero"), (9, "\ud83d".encode("utf-16-le", "surrogatepass").decode("utf-16-le", "ignore") + "🙂 é\x00")]


@pytest.fixture(scope="module")
def docs(docs_of):
    return docs_of(ROWS, **CLASHING).repartition(3)


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 0, 1), (None, 1, None), (7, 0, 1), (6, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, "never found anywhere in these documents at all"), (2, None), (None, ""), (1, "never found anywhere in these documents at all")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


def counts(rows, names=("doc_id",)):
    return sorted((str(tuple(r[n] for n in names)) for r in rows))


EVERY_ROW = {
    "lines": lambda d: linededup.line_dedup(d, report=True),
    "spans": lambda d: spans.span_dedup(d),
    "simhash": lambda d: simhash.simhash_groups(d),
    "shards": lambda d: sharding.shard_by_bytes(d, shards=5),
    "bpe": lambda d: bpe.bpe_digests(d, vocabulary_path()),
}


@pytest.mark.parametrize("name", sorted(EVERY_ROW))
def test_operators_return_every_row(docs, docs_of, name):
    got = EVERY_ROW[name](docs).collect()
    assert counts(got) == sorted(str((i,)) for i, _ in ROWS)
    assert EVERY_ROW[name](docs_of([], **CLASHING)).count() == 0


def test_quality_scores_every_row(spark, docs, docs_of):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(docs_of([(i, "fine words here. " * (1 + i % 3) if i % 2 else "NO!! " * 4) for i in range(60)]), labels)
    assert counts(quality.quality_scores(docs, model).collect()) == sorted(str((i,)) for i, _ in ROWS)


def test_columns_stay_as_they_are(docs):
    for out in (linededup.line_dedup(docs), simhash.simhash_dedup(docs), spans.span_dedup(docs).drop("n_sentences", "n_removed")):
        assert out.columns == docs.columns and {r["_k1"] for r in out.select("_k1").collect()} == {"clash"}


def test_long_texts_are_deduplicated(docs):
    left = {r.doc_id: r.text for r in spans.span_dedup(docs).where("doc_id in (5, 6)").collect()}
    assert left[5].startswith("w0 end0.") and len(left[6]) < 100
    kept = sorted((str(r.doc_id), r.text) for r in simhash.simhash_dedup(docs).select("doc_id", "text").collect() if r.text and r.text != LONG)
    assert ("7", "tie") in kept and ("8", "tie") not in kept and ("7", "another text under the same id") in kept and ("6", LONG + " more") not in kept
    assert {r.doc_id for r in simhash.simhash_dedup(docs).collect()} == {1, 2, 5, 7, None, -3, 9}


def test_leaks_in_long_texts(spark, docs):
    item = " ".join(LONG.split()[50_001:50_030])
    found = decontaminate.contained_items(docs, spark.createDataFrame([(1, item), (None, item), (2, "tie")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(5, 1), (6, 1), (5, None), (7, 2), (8, 2)} and all(r.containment == 1 for r in found)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edges(spark, docs, docs_of, tables, name, stage):
    out = stage(spark, docs, tables)
    assert name == "tokens" or out.columns == docs.columns
    n = out.count()
    assert n == len(ROWS) if name == "tokens" else 0 < n <= len(ROWS)
    assert stage(spark, docs_of([], **CLASHING), tables).count() == 0


def test_pipeline_without_labels_or_items(spark, docs_of, tmp_path):
    docs_of([(1, "Some words to keep."), (2, None), (None, "Other words without an id.")]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, None} and got[2] == 0 and got[1] > 0


def test_pages_on_edges(spark):
    rows = [(1, "http://a.example/", "<p>" + "word " * 200_000), (None, None, None), (1, "http://a.example/", "<p>x</p>"), (2, "not a url", "\x00<"), (3, "http://a.example/", "<div" * 50_000)]
    pages = spark.createDataFrame([(*r, *CLASHING.values()) for r in rows], ", ".join(["page_id long, url string, html string", *(f"`{k}` string" for k in CLASHING)]))
    assert counts(htmltext.main_text(pages).collect(), ("page_id", "url")) == sorted(str(r[:2]) for r in rows)
    out = warc.archived(pages).collect()
    assert counts(out, ("page_id",)) == sorted(str(r[:1]) for r in rows) and {r.record_type for r in out} == {"response"}


def test_vectors_on_edges(spark):
    rows = [(1, [1.0] * 8, 0), (2, [1.0] * 8, 0), (2, [1.0] * 8, 0), (None, [1.0] * 8, 0), (3, [1.0] * 8, None), (4, [], 0), (5, [float("inf")] * 8, 0), (6, [1e-300] * 8, 0), (7, [-1.0] * 8, 0)]
    frame = spark.createDataFrame([(*r, *CLASHING.values()) for r in rows], ", ".join(["vec_id long, embedding array<double>, label int", *(f"`{k}` string" for k in CLASHING)]))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 6: (2, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 7: (0, 7, True)}
    assert np.isfinite(embeddings.audit(frame.where("vec_id is not null").dropDuplicates(["vec_id"]), embeddings.near_vectors(frame), every_nth=1).first().recall)


def test_a_text_of_very_many_equal_lines_is_cut_in_linear_time(docs_of):
    import time

    took = []
    for n in (20_000, 300_000):
        began = time.time()
        out = linededup.line_dedup(docs_of([(1, "the same line, over and over again\n" * n)]), report=True).collect()
        took.append(time.time() - began)
        assert out[0].text == "the same line, over and over again\n" and out[0].n_lines == n + 1
    assert took[1] < 60
