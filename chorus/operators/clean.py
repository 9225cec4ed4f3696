"""Cleaning stage: text hygiene, validity with a drop reason, field normalisation.

One narrow (shuffle-free) projection over the input; rows are never removed
here -- ``drop_reason`` says why a row would be dropped, and ``valid_rows``
/ ``rejected_rows`` split on it, so cleaning output, rejects and the funnel
come from the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus import lexicons as LX
from chorus.functions import normalize as N
from chorus.functions.scores import cleaner_spam, is_english
from chorus.functions.text import clean_text_native, has_alnum
from chorus.functions.udfs import unescape_nfkc

DROP_REASONS = ["too_short", "too_long", "few_alnum", "spam", "language", "bad_number"]


def clean_text(c, decode: bool = True):
    """Full ``clean_text``: HTML unescape + NFKC (Arrow UDF, only where needed), then steps 3-9."""
    return clean_text_native(unescape_nfkc(c) if decode else c)


def validity_reason(content, min_length: int = LX.MIN_CONTENT_LENGTH, max_length: int = LX.MAX_CONTENT_LENGTH,
                    caps_on_original: bool = False, markers=None, low=None):
    """First failing validity rule on cleaned content, NULL when valid; ``low``: a column that holds it in lower case."""
    n = F.length(content)
    return (F.when(n < min_length, "too_short")
            .when(n > max_length, "too_long")
            .when(~has_alnum(content, 5), "few_alnum")
            .when(cleaner_spam(content, caps_on_original=caps_on_original, low=low), "spam")
            .when(~is_english(content, markers, low=low), "language"))


def clean(df: DataFrame, min_length: int = LX.MIN_CONTENT_LENGTH, max_length: int = LX.MAX_CONTENT_LENGTH,
          decode: bool = True, caps_on_original: bool = False, as_of: str | None = None,
          markers=None) -> DataFrame:
    """Clean title/content, flag validity, normalise rating/date/counts.

    Adds ``raw_content, original_length, cleaned_length, cleaned_content,
    drop_reason, cleaned_at``; replaces ``title, content, rating,
    review_date, helpful_count, reply_count`` with their normalised values.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)

    def num_col(name):
        return (F.col(name), types.get(name)) if name in types else (F.lit(None), None)

    rating, rating_t = num_col("rating")
    helpful, helpful_t = num_col("helpful_count")
    reply, reply_t = num_col("reply_count")
    review_date = F.col("review_date") if "review_date" in types else F.lit(None).cast("string")
    title = F.col("title") if "title" in types else F.lit(None).cast("string")

    content_c = clean_text(F.col("content"), decode)
    out = df.withColumns({
        "raw_content": F.col("content"),
        "title": clean_text(title, decode),
        "content": content_c,
    }).withColumn("_low", F.lower("content"))
    reason = validity_reason(F.col("content"), min_length, max_length, caps_on_original, markers, F.col("_low"))
    bad_number = (N.is_infinite(rating, rating_t) | N.is_infinite(helpful, helpful_t) | N.is_infinite(reply, reply_t))
    out = out.withColumns({
        "drop_reason": F.coalesce(reason, F.when(bad_number, F.lit("bad_number"))),
        "rating": N.normalize_rating(rating, rating_t),
        "review_date": N.normalize_date(review_date),
        "helpful_count": N.normalize_count(helpful, helpful_t),
        "reply_count": N.normalize_count(reply, reply_t),
        "original_length": F.length(F.coalesce(F.col("raw_content"), F.lit(""))),
        "cleaned_length": F.length(F.col("content")),
        "cleaned_content": F.col("content"),
        "cleaned_at": F.lit(as_of).cast("string"),
    })
    return out.drop("_low")


def with_cleaned_content(df: DataFrame) -> DataFrame:
    """Rows of ``clean`` that were kept without ``cleaned_content``, with it: it equals ``content``."""
    at = df.columns.index("cleaned_length") + 1
    return df.select(*df.columns[:at], F.col("content").alias("cleaned_content"), *df.columns[at:])


def valid_rows(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.col("drop_reason").isNull())


def rejected_rows(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.col("drop_reason").isNotNull())
