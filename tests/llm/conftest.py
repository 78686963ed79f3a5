import pytest

SCHEMA = "text string, doc_id long, lang string, digest string, key int"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text); other columns clash with internal names."""
    return lambda rows: spark.createDataFrame([(t, i, "en", "x", 1) for i, t in rows], SCHEMA)
