import pytest
from pyspark.sql import functions as F

LONG = "word " * 30_000

#: Nulls, empty and white-space texts, ties, repeated rows, a very long text, text in many scripts, and clashing column names.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "same  text here"), (5, "same text\nhere"), (5, "same text\nhere"), (None, "no id"), (7, LONG),
       (8, "日本語 ▁x é\x00 \U0001F600"), (9, "one"), (10, None)]
NAMES = ["size", "key", "row", "node", "kept", "score", "pieces", "n_words", "spans", "main_text", "keep_id", "label"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with odd rows and columns named like what operators make."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({n: F.lit("own") for n in NAMES})


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 0, 1), (9, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


