import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, host string"
CLASHES = ("position", "copies", "block", "lane0", "_key", "node", "label", "seq")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeats, ties, and columns whose names clash with outputs."""
    rows = [(i, f"word{i % 7} and some other words number {i} of this small text", "en", f"s{i % 3}", 1, "x", "y") for i in range(60)]
    rows += [(100, None, "en", "s0", 1, "x", "y"), (101, "", None, None, None, None, None), (None, "no id here", "de", None, 3, "a", "b")]
    rows += [(102, " \n two  spaces\u00a0and\ttabs \n", "fr", "s1", 1, "x", "y"), (103, "long " * 30_000, "en", "s2", 1, "x", "y")]
    rows += [(7, rows[7][1], "en", "s1", 1, "x", "y")] * 2
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The odd rows with more columns that are named like the operators' own."""
    from pyspark.sql import functions as F

    return odd_docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
