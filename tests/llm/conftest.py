import pytest

#: Nulls in every column, empty and long texts, ties, repeated rows.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (None, "one two", None, "b", None),
    (5, "  The quick brown fox jumps over\nthe lazy dog again and again ", "en", "b", 3),
    (6, "x" * 30_000, "de", "c", 30_000),
    (7, "word " * 3_000, "fr", None, 1),
    (8, "ünïcödé 日本語 😀 text with a+b@mail.example.com and 4111 1111 1111 1111", "es", "d", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["key", "alarm", "row", "leaks", "score", "word", "cell", "text_sha256", "signature"]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, messy):
    from pyspark.sql import functions as F

    return messy.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
