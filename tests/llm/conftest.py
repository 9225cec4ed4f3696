import pytest
from pyspark.sql import types as T

#: A documents table with every awkward row: nulls, empty and very long texts, ties, repeated rows.
LONG = " ".join(f"word{k % 997} and{k % 13}" for k in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 58),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 58),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 58),
    (3, None, "en", "a", None),
    (4, "", None, "b", 0),
    (5, " \n\t ", "en", None, 4),
    (6, "two words", "en", "c", 9),
    (7, LONG, "en", "c", len(LONG)),
    (8, "x" * 100_000, "en", "c", 100_000),
    (9, "Ünïcode ß É 日本語   \x1c tab\tend  two  spaces .", "de", "c", 40),
    (None, "a row without an id", "en", "c", 19),
    (10, "same text", "en", "c", 9),
    (11, "same text", "en", "c", 9),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()),
                       # Names that operators use themselves.
                       T.StructField("score", T.StringType()), T.StructField("hash", T.IntegerType()),
                       T.StructField("cid", T.LongType()), T.StructField("bucket", T.LongType()),
                       T.StructField("_text", T.StringType())])


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame([r + ("own", 7, 1, 2, "mine") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
