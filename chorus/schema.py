"""Schemas: the review record (export column order) and landed API shapes."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()

# Field order is the export column order.
REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", S), T.StructField("platform", S), T.StructField("app_name", S),
    T.StructField("content", S), T.StructField("title", S), T.StructField("rating", I),
    T.StructField("user_id", S), T.StructField("username", S), T.StructField("verified", B),
    T.StructField("review_date", S), T.StructField("scraped_at", S), T.StructField("processed_at", S),
    T.StructField("helpful_count", L), T.StructField("reply_count", L),
    T.StructField("app_id", S), T.StructField("version", S), T.StructField("language", S),
    T.StructField("country", S), T.StructField("device", S), T.StructField("source_url", S),
    T.StructField("cleaned_content", S), T.StructField("primary_category", S),
    T.StructField("category_scores", T.MapType(S, D)), T.StructField("classification_confidence", D),
    T.StructField("sentiment", S), T.StructField("sentiment_score", D),
    T.StructField("keywords_found", T.ArrayType(S)),
    T.StructField("is_duplicate", B), T.StructField("is_spam", B), T.StructField("quality_score", D),
    T.StructField("raw_data", S),
])
REVIEW_FIELDS = [f.name for f in REVIEW_SCHEMA.fields]

# One review as returned by the review API (all optional, loosely typed).
API_REVIEW = T.StructType([
    T.StructField("query", S), T.StructField("review_id", S), T.StructField("review_rating", S),
    T.StructField("review_title", S), T.StructField("review_text", S), T.StructField("author_title", S),
    T.StructField("author_name", S), T.StructField("review_updated", S),
    T.StructField("review_date_formated", S), T.StructField("vote_sum", S), T.StructField("vote_count", S),
    T.StructField("version", S), T.StructField("country", S), T.StructField("review_timestamp", L),
])

# Landed store-review dump and forum shapes.
STORE_REVIEW = T.StructType([
    T.StructField("reviewId", S), T.StructField("userName", S), T.StructField("score", D),
    T.StructField("content", S), T.StructField("at", S), T.StructField("thumbsUpCount", L),
    T.StructField("appVersion", S),
])
