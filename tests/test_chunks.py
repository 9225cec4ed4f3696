"""Row and chunk numbers beyond what one sample or one task holds."""

from pyspark.sql import functions as F

from chorus.operators.chunks import chunk_numbers, row_numbers


def test_chunks_of_400_000_rows_are_exact(spark):
    # Three groups over 9 partitions; a row's number within its group is known from its ordinal.
    df = spark.range(0, 400_000, 1, 9).select(F.col("id").alias("ord"), (F.col("id") % 3).alias("g"))
    df = df.repartition(9, F.xxhash64("ord"))
    wrong = chunk_numbers(df, ["g"], 100).where(
        F.col("chunk") != F.floor(F.floor(F.col("ord") / 3) / 100))
    assert wrong.count() == 0
    assert chunk_numbers(df, ["g"], 100).count() == 400_000


def test_gaps_nulls_and_two_keys(spark):
    rows = [("a", None, 5), ("a", None, 1_000_000_007), ("a", None, 20_000), ("a", "x", 3), (None, "x", 9), (None, "x", 2),
            ("b", "y", None), ("b", "y", 4)]
    df = spark.createDataFrame(rows, "g string, h string, ord long")
    got = {(r.g, r.h, r.ord): r.row_number for r in row_numbers(df, ["g", "h"]).collect()}
    assert got == {("a", None, 5): 1, ("a", None, 20_000): 2, ("a", None, 1_000_000_007): 3, ("a", "x", 3): 1,
                   (None, "x", 2): 1, (None, "x", 9): 2, ("b", "y", None): 1, ("b", "y", 4): 2}
