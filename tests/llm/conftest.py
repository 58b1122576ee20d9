import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of texts, or of (doc_id, text) pairs."""

    def make(texts, **extra):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        return df.withColumns({k: F.lit(v) for k, v in extra.items()})

    return make


@pytest.fixture
def awkward(docs):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names that the operators use."""
    long = "word " * 40_000
    return docs([(1, None), (2, ""), (3, long), (4, "same text in two rows"), (4, "same text in two rows"), (None, "no id here at all"), (5, "é\n\n ñ"), (5, "another text")], row="x", _keep="y", fp=1, n=2, k="z", score=0.5, total=3, block=4)
