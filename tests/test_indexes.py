"""Vector and page indexes give what scans give, and read few rows and files for it."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scale import records_read

from snaplake.operators import pageindex, search, sessions, vectorindex


@pytest.fixture(scope="module")
def vectors(spark):
    """Groups around forty directions, copies, and rows that have no direction."""
    rng = np.random.default_rng(3)
    around = rng.normal(size=(40, 12))
    rows = [(i, (around[i % 40] * rng.uniform(0.5, 9) + rng.normal(size=12) * 0.15).astype(np.float32).tolist()) for i in range(8_000)]
    rows += [(9_000 + i, rows[7][1]) for i in range(30)] + [(7, rows[7][1]), (None, rows[1][1]), (9_100, None), (9_101, []), (9_102, [0.0] * 12), (9_103, [math.nan] * 12), (9_104, [1.0, None] * 6), (9_105, [math.inf] + [1.0] * 11), (9_106, [1.0] * 5)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cell": F.lit("clash"), "d": F.lit(1)}).repartition(6)


@pytest.fixture(scope="module")
def vector_index(vectors, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("vectors"))
    vectorindex.build(vectors, "vec_id", "embedding", folder, cells=40)
    return folder


@pytest.fixture(scope="module")
def sound(vectors):
    return vectors.where("vec_id is not null and (vec_id < 9100)").cache()


@pytest.mark.parametrize("k", [1, 10, 45, 100_000])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_the_best_vectors_equal_the_scan(spark, sound, vector_index, k, seed):
    rng = random.Random(seed)
    query = sound.where(f"vec_id = {7 if not seed else rng.randrange(8_000)}").first().embedding if seed < 2 else [rng.gauss(0, 1) for _ in range(12)]
    got = [tuple(r) for r in vectorindex.search(spark, vector_index, query, k).collect()]
    assert got == [tuple(r) for r in search.top(search.semantic(sound, "vec_id", "embedding", query), k).collect()]
    assert len(got) == min(k, 8_031)


@pytest.mark.parametrize("least", [-1.0, 0.5, 0.99, 1.1])
def test_all_vectors_within_a_range(spark, sound, vector_index, least):
    query = sound.where("vec_id = 11").first().embedding
    got = {tuple(r) for r in vectorindex.within(spark, vector_index, query, least).collect()}
    assert got == {tuple(r) for r in search.semantic(sound, "vec_id", "embedding", query).where(F.col("score") >= least).collect()}


def test_few_vectors_are_read(spark, vectors, vector_index, monkeypatch):
    query = vectors.where("vec_id = 11").first().embedding
    found, read = records_read(spark, lambda: vectorindex.search(spark, vector_index, query, 10).collect())
    assert len(found) == 10 and read < 8_031 / 2
    monkeypatch.setattr(vectorindex, "NAMED", 0)  # cells by a join
    assert vectorindex.search(spark, vector_index, query, 10).collect() == found


def test_vector_index_edges(spark, vectors, vector_index, tmp_path):
    for bad in ([0.0] * 12, [1.0] * 5, [math.nan] * 12):
        with pytest.raises(ValueError):
            vectorindex.search(spark, vector_index, bad, 3)
    vectorindex.build(vectors.limit(0), "vec_id", "embedding", str(tmp_path))
    assert vectorindex.search(spark, str(tmp_path), [1.0, 2.0], 3).count() == 0 and vectorindex.within(spark, str(tmp_path), [1.0], 0.1).count() == 0


@pytest.fixture(scope="module")
def listed(spark):
    rng = random.Random(8)
    rows = [(f"s{i:05d}", rng.choice([None, f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"]) if i % 9 == 0 else f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", i) for i in range(6_000)]
    return spark.createDataFrame(rows, "id string, last_active string, file int").repartition(5)


@pytest.fixture(scope="module")
def order(listed, tmp_path_factory):
    """An index in three runs: most rows, later ones all over the order, a few."""
    folder = str(tmp_path_factory.mktemp("pages"))
    pageindex.append(listed.where("file % 10 < 7"), folder, rows_a_file=100)
    pageindex.append(listed.where("file % 10 in (7, 8)"), folder, rows_a_file=100)
    pageindex.append(listed.where("file % 10 = 9").unionByName(listed.limit(1).withColumn("id", F.lit(None).cast("string"))), folder, rows_a_file=100)
    return folder


def test_pages_equal_the_scan(spark, listed, order):
    cursor = None
    for n in (0, 1, 30, 75, 110, 119, 120):
        if n:
            last = listed.orderBy(F.desc_nulls_last("last_active"), F.desc("id")).offset(n * 50 - 1).limit(1).first()
            cursor = sessions.cursor_of(last.last_active, last.id)
        got = pageindex.page(spark, order, 50, cursor).select("id", "last_active", "file").collect()
        assert got == sessions.page(listed, 50, cursor).collect() and len(got) == min(51, 6_000 - n * 50)
        assert len(pageindex.files_of(spark, order, 50, cursor)) <= 10


def test_a_deep_page_opens_few_files(spark, listed, order, tmp_path):
    pageindex.compact(spark, order, str(tmp_path), rows_a_file=100)
    last = listed.orderBy(F.desc_nulls_last("last_active"), F.desc("id")).offset(4_999).limit(1).first()
    cursor = sessions.cursor_of(last.last_active, last.id)
    assert spark.read.parquet(f"{tmp_path}/bounds").count() >= 50 and len(pageindex.files_of(spark, str(tmp_path), 50, cursor)) <= 3
    assert pageindex.page(spark, str(tmp_path), 50, cursor).select("id").collect() == sessions.page(listed, 50, cursor).select("id").collect()


def test_pages_of_nothing(spark, listed, tmp_path):
    pageindex.append(listed.limit(0), str(tmp_path))
    assert pageindex.page(spark, str(tmp_path), 10).count() == 0
