import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 40_000
CLEAN = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, CLEAN, "en", "a", 90), (1, CLEAN, "en", "a", 90), (2, None, "en", "a", None), (3, "", None, "a", 0),
        (4, LONG, "en", None, len(LONG)), (None, CLEAN + " more", "en", "b", 95), (5, "  \n\t ", "de", "b", 5), (6, "word", "de", None, 4),
        (7, CLEAN, "en", "b", 90), (8, "été ça \U0001F600 \u4e2d\u6587 it's 12 a\u0301\n\nx\r\nx\nx", "fr", "c", 30), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = {c: F.lit(7) for c in ("kept", "copies", "size", "node", "accepted", "ids", "score", "n_words", "fingerprint", "key", "root")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
