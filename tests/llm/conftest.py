import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with the table's other columns."""

    def make(rows, **more):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {k} string" for k in more)
        return spark.createDataFrame([(i, t, "en", "src0", len(t) if t else 0, *more.values()) for i, t in rows], schema)

    return make
