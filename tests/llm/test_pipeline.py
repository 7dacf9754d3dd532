"""The pipeline against brute force, stage by stage."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from snaplake.llm import quality
from snaplake.llm.queries import vocabulary_path

from test_dedup import brute_contained, brute_lines, brute_near


def test_run_equals_brute_force(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("n_chars", "doc_id").limit(70)
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, " ", "en", "s", 1)], docs.schema)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    leak = spark.createDataFrame([(9004, f"Before it. {item} After it.", "en", "s", 9)], docs.schema)
    docs.unionAll(extra).unionAll(leak).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmark", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns

    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = model.names
    stats = quality.with_features(docs, "text", [docs.doc_id, docs.text]).select("doc_id", "text", *names).collect()
    score = model.scores(np.array([[r[n] for n in names] for r in stats], float))
    rows = [(r.doc_id, r.text) for r, s in zip(stats, score) if s >= quality.ACCEPT]
    cut = brute_lines(rows, 2, 24)
    rows = [(d, cut[d, t]) for d, t in rows if not (t or "").strip() or (cut[d, t] or "").strip()]
    rows = brute_near(rows)[0]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in brute_contained(rows, items)}
    assert 9004 in leaks or 9004 not in {d for d, _ in rows}
    tokens = Tokenizer.from_file(vocabulary_path())
    expected = {d: tokens.encode(t or "", add_special_tokens=False).ids for d, t in rows if d not in leaks}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == expected and len(got) > 20
