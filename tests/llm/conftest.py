import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of the given texts, or of (doc_id, text) pairs."""
    def make(texts, lang="en", source="src0"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return make
