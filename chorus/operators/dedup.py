"""Exact, spam and per-user de-duplication.

Every "first/best row per key" is computed as a *grouped aggregate*
(``min(ord)`` or ``max(struct(score, -ord))``), which Spark pre-aggregates
map-side, so a key holding a third of all rows costs one row per map task
in the shuffle.  Winners are then joined back on the unique ``ord`` --
a skew-free key -- instead of using a window over the (possibly hot)
grouping key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.functions.scores import is_review_spam, quality_score, review_spam_hits
from chorus.functions.text import content_hash, ws_words

BATCH = ("app_name", "platform")


def with_content_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", content_hash("title", "content"))


def with_quality(df: DataFrame, as_of: str) -> DataFrame:
    return df.withColumn("quality_score", quality_score("content", "helpful_count", "verified", "title",
                                                        "review_date", as_of))


def first_per_key(df: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """The ``ord`` values of the first row (lowest ``order``) of every key."""
    return df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, order: str = "ord") -> DataFrame:
    """The ``ord`` of the highest-``score`` row of every key; the first row wins ties."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("neg")))
    return df.groupBy(*keys).agg(best.alias("b")).select((-F.col("b.neg")).alias(order))


def hash_dedup(df: DataFrame, batch: Sequence[str] = BATCH) -> DataFrame:
    """Keep the first row (by ``ord``) of every (batch, content hash)."""
    h = df if "content_hash" in df.columns else with_content_hash(df)
    return h.join(first_per_key(h, [*batch, "content_hash"]), "ord", "left_semi")


def with_spam(df: DataFrame, caps_on_original: bool = False) -> DataFrame:
    """``spam_hits``, then ``is_spam`` from that column: the patterns run once per row, and the words are split once."""
    hit = df.withColumns({"spam_hits": review_spam_hits("title", "content"),
                          "_words": ws_words(F.lower(F.coalesce("content", F.lit(""))))})
    return hit.withColumn("is_spam", is_review_spam("title", "content", caps_on_original=caps_on_original,
                                                    hits="spam_hits", words="_words")).drop("_words")


def user_dedup(df: DataFrame, batch: Sequence[str] = BATCH, score: str = "quality_score",
               skip_null_user: bool = False) -> DataFrame:
    """Best row per (batch, user_id, app_name); anonymous rows of an app form one group.

    ``skip_null_user=True`` keeps every anonymous row instead.
    """
    keys = list(dict.fromkeys([*batch, "user_id", "app_name"]))
    if skip_null_user:
        named = df.where(F.col("user_id").isNotNull())
        kept = named.join(best_per_key(named, keys, score), "ord", "left_semi")
        return kept.unionByName(df.where(F.col("user_id").isNull()))
    return df.join(best_per_key(df, keys, score), "ord", "left_semi")
