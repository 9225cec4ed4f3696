"""Report state that merges: counters, sums and a distinct-users sketch per batch and day.

``report_state`` reads flagged rows once; states of different rows (days, runs, files) merge by adding up, without the
rows.  Counters and sums are exact; the number of users is a HyperLogLog estimate (2**12 cells: a standard error of 1.6 %).
A state holds a row per batch and day, whatever the number of reviews.  Rows without a date have a state of their own;
null users do not count; no rows give no state.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.operators.dedup import BATCH
from chorus.operators.reports import processed

COUNTERS = ["total_reviews", "processed_reviews", "high_quality_reviews", "spam_reviews", "duplicate_reviews",
            "rated_reviews", "rating_sum", "sentiment_sum"]


def report_state(flagged: DataFrame, batch: Sequence[str] = BATCH) -> DataFrame:
    """(batch, day, counters and sums, users) of flagged rows; ``users`` is a sketch."""
    rated = processed() & F.col("rating").isNotNull() & (F.col("rating") != 0)
    n = lambda cond: F.count(F.when(cond, 1))
    total = lambda value, cond: F.coalesce(F.sum(F.when(cond, value.cast("double"))), F.lit(0.0))
    return flagged.groupBy(*batch, F.substring("review_date", 1, 10).alias("day")).agg(
        F.count(F.lit(1)).alias("total_reviews"), n(processed()).alias("processed_reviews"),
        n(F.col("is_high_quality")).alias("high_quality_reviews"), n(F.col("is_spam")).alias("spam_reviews"),
        n(F.col("is_duplicate")).alias("duplicate_reviews"), n(rated).alias("rated_reviews"),
        total(F.col("rating"), rated).alias("rating_sum"), total(F.col("sentiment_score"), processed()).alias("sentiment_sum"),
        F.hll_sketch_agg("user_id", F.lit(12)).alias("users"))


def merged(states: Sequence[DataFrame], keys: Sequence[str] = (*BATCH, "day")) -> DataFrame:
    """One state of several, by ``keys``: those of the states, or fewer to add up over days or batches."""
    return (reduce(DataFrame.unionByName, states).groupBy(*keys)
            .agg(*[F.sum(c).alias(c) for c in COUNTERS], F.hll_union_agg("users").alias("users")))


def report_of(state: DataFrame) -> DataFrame:
    """Counts, averages (0 where there is nothing to average) and the estimated number of users of each row of a state."""
    mean = lambda total, n: F.coalesce(F.try_divide(total, n), F.lit(0.0))
    keys = [c for c in state.columns if c not in (*COUNTERS, "users")]
    return state.select(*keys, *COUNTERS[:5], mean("rating_sum", "rated_reviews").alias("average_rating"),
                        mean("sentiment_sum", "processed_reviews").alias("average_sentiment_score"),
                        F.hll_sketch_estimate("users").alias("users"))
