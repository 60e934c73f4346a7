import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with internal ones."""
    def make(rows, lang="en", source="s"):
        return spark.createDataFrame(
            [(i, t, lang, source, len(t or ""), "x", 7, "y") for i, t in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint, "
            "id string, size bigint, content string")
    return make
