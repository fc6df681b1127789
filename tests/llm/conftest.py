import pytest

LONG = "alpha beta gamma delta " * 30_000


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows, and columns of clashing names."""
    text = "the quick brown fox jumps over the lazy dog near the river bank while the sun sets slowly behind the hills"
    rows = [(1, text, "en", "s", 10), (1, text, "en", "s", 10), (2, None, "en", "s", None), (3, "", None, None, 0), (4, " \n\t ", "en", None, 4), (None, text + " today", None, "s", 5), (5, LONG, "en", "s", 7), (6, text, "de", "t", 1), (7, "ä😀 token=abcdEFGH1234", "de", "t", 1), (8, "ß", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    names = ["row", "key", "hilbert", "_q_", "_s_row", "size", "id", "copies", "bucket", "q", "value", "hash", "l", "s"]
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(n).alias(n) for n in names])


@pytest.fixture(scope="session")
def nothing(nasty):
    return nasty.where("false")
