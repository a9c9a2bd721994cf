import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names clash with results."""

    def build(pairs):
        rows = [(d, t, "en", "s", len(t or ""), 7, "x", 1.0) for d, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", keep_id int, key string, score double")

    return build


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
