import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, equal texts, columns with clashing names."""
    long_text = " ".join(f"word{i % 997} and{i}" for i in range(20_000))
    rows = [(1, "the quick brown fox jumps over the lazy dog " * 6, "en", "a", 1, "k", "r"),
            (2, "the quick brown fox jumps over the lazy dog " * 6, "en", "a", 1, "k", "r"),
            (2, "the quick brown fox jumps over the lazy dog " * 6, "en", "a", 1, "k", "r"),
            (3, "", "en", "b", 0, None, None), (4, None, None, None, None, None, None),
            (None, "one two", "en", None, 7, "k", "r"), (None, None, None, None, None, None, None),
            (5, " \t\n\x0b\x0c\r ", "de", "b", 1, "x", "y"), (6, long_text, "en", "c", 1, "x", "y"),
            (7, "é" * 300 + " ünï çode \u2003 x", "fr", "a", 1, "x", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
