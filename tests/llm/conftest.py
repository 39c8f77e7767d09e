import pytest


@pytest.fixture
def documents(spark):
    """Builds documents with the given texts, ids from 1, and columns whose names clash."""
    def build(texts, ids=None, more="fingerprint string, batch int, n_words long"):
        rows = [(i, text, "x", 1, 2) for i, text in zip(ids or range(1, len(texts) + 1), texts)]
        return spark.createDataFrame(rows, f"doc_id long, text string, {more}")
    return build
