import pytest


@pytest.fixture()
def docs(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with those used inside."""

    def make(rows, **more):
        rows = [(i, t, more.get("lang", "en"), more.get("source", "s"), None if t is None else len(t), 1, "x") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, token string")

    return make
