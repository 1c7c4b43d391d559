import pytest

SF = "/root/testdata/sf0.001"

#: Rows with nulls, empty and odd texts, ties, repeated rows and copies; other columns clash with those that operators add.
LONG = " ".join(f"w{i % 97}" for i in range(5000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ROWS = [
    (1, f"start {PASSAGE} end of the first", "b", 1),
    (2, f"other {PASSAGE} tail", "a", 1),
    (3, None, None, 0),
    (4, "", "a", 0),
    (5, " \n\t ", "b", 0),
    (6, LONG, "c", 0),
    (7, LONG, "c", 0),
    (8, "Released under the MIT License. Apache License, Version 2.0. CC BY-NC", None, 0),
    (8, "Released under the MIT License. Apache License, Version 2.0. CC BY-NC", None, 0),
    (9, "é" * 300 + " x " + "é" * 300, "ß", 0),
    (None, f"no id {PASSAGE}", "a", 0),
    (10, "aaaa" * 300, "b", 0),
    (11, "same line\nsame line\n\nSame line\nsame line", "b", 0),
    (12, "<|endoftext|> is text  here and there 's", "b", 0),
    (13, f"{PASSAGE} {PASSAGE}", "b", 0),
]
SCHEMA = "doc_id bigint, text string, source string, n_words int"
#: Names that operators give to columns of their own.
CLASHES = "d d_ t_ s_ h_ n_ th th_ row key fp root size size_ taken taken_ copy copy_ number nth salt band rest target rate component score".split()


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def clashing(odd):
    """Documents that have all those names too."""
    from pyspark.sql import functions as F

    return odd.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("bigint").alias("n_chars"), *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))
