"""Registered queries: one per operator family, each with its DuckDB oracle.

Every query reads the driver's tables (whole tables, no row caps) and
returns a DataFrame of primitive columns; doubles are rounded to 6 places
on both sides so the engines compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.functions import scores as SC
from chorus.functions import text as T
from chorus.operators.classify import classify
from chorus.operators.clean import clean, with_cleaned_content
from chorus.operators.dedup import best_per_key, hash_dedup
from chorus.plans import sql as S
from chorus.plans.pipeline import AS_OF, TEST_SETTINGS, Settings, prepared
from chorus.sources.testdata import reviews_from_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(T.col(c), 6)


# ------------------------------------------------------------------ shared inputs
def reviews(spark, sf) -> DataFrame:
    return reviews_from_documents(spark, sf)


def cleaned(spark, sf) -> DataFrame:
    """The clean stage, written once per session as a stage table that the pipeline's queries share (see plans.store)."""
    from chorus.plans.pipeline import cleaned_documents
    return cleaned_documents(spark, sf)


def valid(spark, sf) -> DataFrame:
    return prepared(cleaned(spark, sf), Settings())


def classified_valid(spark, sf) -> DataFrame:
    return classify(valid(spark, sf), TEST_SETTINGS["lexicon"], TEST_SETTINGS["positive"],
                    TEST_SETTINGS["negative"], as_of=AS_OF)


# ------------------------------------------------------------------ 1.x ingest
@query("canonical_reviews", S.with_base("""
SELECT ord, review_id, platform, app_name, title, content, rating, user_id, user_id AS username, verified,
       coalesce(helpful_count, 0) AS helpful_count, coalesce(reply_count, 0) AS reply_count, review_date,
       '{}' AS raw_data, '2025-01-01T00:00:00' AS scraped_at
FROM reviews"""))
def q_canonical_reviews(spark, sf):
    from chorus.sources.landed import canonical
    return canonical(reviews(spark, sf), scraped_at=AS_OF).select(
        "ord", "review_id", "platform", "app_name", "title", "content", "rating", "user_id", "username",
        "verified", "helpful_count", "reply_count", "review_date", "raw_data", "scraped_at")


@query("validate_rejects", S.with_base("""
SELECT ord, CASE WHEN coalesce(review_id, '') = '' THEN 'missing_review_id'
                 WHEN coalesce(platform, '') = '' THEN 'missing_platform'
                 WHEN coalesce(app_name, '') = '' THEN 'missing_app_name'
                 WHEN rating IS NOT NULL AND (rating < 1 OR rating > 5) THEN 'rating_out_of_range' END AS reject_reason
FROM reviews"""))
def q_validate_rejects(spark, sf):
    from chorus.sources.landed import reject_reason
    return reviews(spark, sf).select("ord", reject_reason().alias("reject_reason"))


# ------------------------------------------------------------------ 10.1 / 4.x cleaning
@query("clean_text", S.with_base("""
SELECT ord, title, content, original_length, cleaned_length FROM cleaned"""))
def q_clean_text(spark, sf):
    return cleaned(spark, sf).select("ord", "title", "content", "original_length", "cleaned_length")


@query("validity_reasons", S.with_base(f"""
SELECT ord, drop_reason, {S.alnum_count('content')} AS alnum_chars FROM cleaned"""))
def q_validity_reasons(spark, sf):
    return cleaned(spark, sf).select("ord", "drop_reason", T.alnum_count("content").alias("alnum_chars"))


@query("cleaner_spam", S.with_base(f"""
SELECT ord, {S.cleaner_spam('content')} AS is_spam FROM cleaned"""))
def q_cleaner_spam(spark, sf):
    return cleaned(spark, sf).select("ord", SC.cleaner_spam("content").alias("is_spam"))


@query("english_filter", S.with_base(f"""
SELECT ord, ({S.english_count('raw_content')}) AS english_markers,
       ({S.english_count('raw_content')}) >= 2 AS is_english FROM cleaned"""))
def q_english_filter(spark, sf):
    return cleaned(spark, sf).select("ord", SC.english_marker_count("raw_content").alias("english_markers"),
                                     SC.is_english("raw_content").alias("is_english"))


# ------------------------------------------------------------------ de-dup family
@query("content_hash", S.with_base("SELECT ord, content_hash FROM valid"))
def q_content_hash(spark, sf):
    return valid(spark, sf).select("ord", "content_hash")


@query("hash_dedup", S.with_base("""
SELECT ord, review_id, app_name, platform, content_hash FROM (
  SELECT *, row_number() OVER (PARTITION BY app_name, platform, content_hash ORDER BY ord) AS rn FROM valid)
WHERE rn = 1"""))
def q_hash_dedup(spark, sf):
    return hash_dedup(valid(spark, sf)).select("ord", "review_id", "app_name", "platform", "content_hash")


@query("quality_score", S.with_base("SELECT ord, review_date, round(quality_score, 6) AS quality_score FROM valid"))
def q_quality_score(spark, sf):
    return valid(spark, sf).select("ord", "review_date", r6("quality_score").alias("quality_score"))


@query("review_spam", S.with_base("SELECT ord, spam_hits, is_spam FROM valid"))
def q_review_spam(spark, sf):
    return valid(spark, sf).select("ord", "spam_hits", "is_spam")


@query("user_dedup", S.with_base("""
SELECT ord, app_name, platform, user_id, round(quality_score, 6) AS quality_score FROM (
  SELECT *, row_number() OVER (PARTITION BY app_name, platform, user_id ORDER BY quality_score DESC, ord) AS rn
  FROM valid) WHERE rn = 1"""))
def q_user_dedup(spark, sf):
    v = valid(spark, sf)
    keys = ["app_name", "platform", "user_id"]
    return (v.join(best_per_key(v, keys, "quality_score"), "ord", "left_semi")
            .select("ord", "app_name", "platform", "user_id", r6("quality_score").alias("quality_score")))


# ------------------------------------------------------------------ classification
_CLS = S.classify_ctes("valid", "cls")


@query("category_scores", S.with_base("""
SELECT ord, round(score_alpha, 6) AS score_alpha, round(score_beta, 6) AS score_beta,
       round(score_gamma, 6) AS score_gamma, round(score_delta, 6) AS score_delta FROM cls""", _CLS))
def q_category_scores(spark, sf):
    c = classified_valid(spark, sf)
    return c.select("ord", *[r6(F.col("category_scores")[k]).alias(f"score_{k}")
                             for k in TEST_SETTINGS["lexicon"]])


@query("primary_category", S.with_base("""
SELECT ord, primary_category, round(classification_confidence, 6) AS classification_confidence FROM cls""", _CLS))
def q_primary_category(spark, sf):
    return classified_valid(spark, sf).select("ord", "primary_category",
                                              r6("classification_confidence").alias("classification_confidence"))


@query("keywords_found", S.with_base("SELECT ord, keywords FROM cls", _CLS))
def q_keywords_found(spark, sf):
    return classified_valid(spark, sf).select("ord", F.array_join("keywords_found", ",").alias("keywords"))


@query("weighted_sentiment", S.with_base("""
SELECT ord, sentiment, round(sentiment_score, 6) AS sentiment_score, n_tokens FROM cls""", _CLS))
def q_weighted_sentiment(spark, sf):
    c = classified_valid(spark, sf)
    return c.select("ord", "sentiment", r6("sentiment_score").alias("sentiment_score"), "n_tokens")


# ------------------------------------------------------------------ flagged pipeline + reports
def flagged(spark, sf, texts=None) -> DataFrame:
    """Pipeline output with the exact, spam and per-user stages (SQL-checkable); ``texts``: as in ``pipeline.process``."""
    from chorus.plans.pipeline import documents_pipeline
    return documents_pipeline(spark, sf, near_dup=False, texts=texts)


_FLAGGED = S.flagged_ctes()


def _rep(select_sql: str) -> str:
    return S.with_base(select_sql, _FLAGGED)


@query("pipeline_stages", _rep("SELECT ord, stage, is_high_quality FROM flagged"))
def q_pipeline_stages(spark, sf):
    return flagged(spark, sf, {}).select("ord", "stage", "is_high_quality")


@query("batch_stats", _rep("""
SELECT app_name, platform, count(*) AS total_reviews,
  count(*) FILTER (WHERE processed_at IS NOT NULL) AS processed_reviews,
  count(*) FILTER (WHERE is_high_quality) AS high_quality_reviews,
  count(*) FILTER (WHERE is_spam) AS spam_reviews,
  count(*) FILTER (WHERE is_duplicate) AS duplicate_reviews,
  round(coalesce(avg(CAST(rating AS DOUBLE)) FILTER (WHERE processed_at IS NOT NULL AND rating IS NOT NULL
        AND rating <> 0), 0.0), 6) AS average_rating,
  round(coalesce(avg(sentiment_score) FILTER (WHERE processed_at IS NOT NULL), 0.0), 6) AS average_sentiment_score
FROM flagged GROUP BY app_name, platform"""))
def q_batch_stats(spark, sf):
    from chorus.operators.reports import batch_stats
    b = batch_stats(flagged(spark, sf, {}))
    return b.withColumns({"average_rating": r6("average_rating"),
                          "average_sentiment_score": r6("average_sentiment_score")})


@query("merged_report", ORACLE["batch_stats"])
def q_merged_report(spark, sf):
    """``batch_stats`` from the merged states of the rows of even and of odd ordinals."""
    from chorus.operators.state import merged, report_of, report_state
    rows = flagged(spark, sf, {})
    halves = [report_state(rows.where(F.col("ord") % 2 == k)) for k in (0, 1)]
    return report_of(merged(halves, ["app_name", "platform"])).drop("users").withColumns({
        "average_rating": r6("average_rating"), "average_sentiment_score": r6("average_sentiment_score")})


@query("category_hist", _rep("""
SELECT app_name, platform, coalesce(primary_category, 'unclassified') AS category, count(*) AS count
FROM flagged WHERE processed_at IS NOT NULL GROUP BY ALL"""))
def q_category_hist(spark, sf):
    from chorus.operators.reports import category_hist
    return category_hist(flagged(spark, sf, {}))


@query("sentiment_hist", _rep("""
SELECT app_name, platform, coalesce(sentiment, 'neutral') AS sentiment, count(*) AS count
FROM flagged WHERE processed_at IS NOT NULL GROUP BY ALL"""))
def q_sentiment_hist(spark, sf):
    from chorus.operators.reports import sentiment_hist
    return sentiment_hist(flagged(spark, sf, {}))


@query("rating_hist", _rep("""
SELECT app_name, platform, rating, count(*) AS count FROM flagged
WHERE processed_at IS NOT NULL AND rating IS NOT NULL AND rating <> 0 GROUP BY ALL"""))
def q_rating_hist(spark, sf):
    from chorus.operators.reports import rating_hist
    return rating_hist(flagged(spark, sf, {}))


@query("overall_stats", _rep("""
SELECT count(*) AS total_reviews, count(*) FILTER (WHERE is_high_quality) AS total_high_quality_reviews,
  count(DISTINCT app_name) AS total_apps, count(DISTINCT platform) AS total_platforms,
  round(coalesce(avg(CAST(rating AS DOUBLE)) FILTER (WHERE processed_at IS NOT NULL AND rating IS NOT NULL
        AND rating <> 0), 0.0), 6) AS average_rating,
  round(coalesce(avg(sentiment_score) FILTER (WHERE processed_at IS NOT NULL), 0.0), 6) AS average_sentiment_score,
  round(CASE WHEN count(*) > 0 THEN (count(*) FILTER (WHERE is_high_quality))::DOUBLE / count(*) ELSE 0.0 END, 6)
    AS quality_rate
FROM flagged"""))
def q_overall_stats(spark, sf):
    from chorus.operators.reports import overall_stats
    o = overall_stats(flagged(spark, sf, {}))
    return o.withColumns({c: r6(c) for c in ["average_rating", "average_sentiment_score", "quality_rate"]})


@query("classification_summary", _rep("""
SELECT count(*) AS total_reviews, round(avg(classification_confidence), 6) AS average_confidence,
  count(*) FILTER (WHERE classification_confidence >= 0.3) AS high_confidence_count,
  count(*) FILTER (WHERE coalesce(primary_category, 'unclassified') = 'unclassified') AS unclassified_count,
  round(1.0 - (count(*) FILTER (WHERE coalesce(primary_category, 'unclassified') = 'unclassified'))::DOUBLE
        / count(*), 6) AS classification_rate,
  (SELECT '{' || string_agg('"' || c || '":' || n, ',' ORDER BY c) || '}' FROM (
     SELECT coalesce(primary_category, 'unclassified') AS c, count(*) AS n FROM flagged WHERE processed_at IS NOT NULL
     GROUP BY 1)) AS category_distribution,
  (SELECT '{' || string_agg('"' || c || '":' || n, ',' ORDER BY c) || '}' FROM (
     SELECT coalesce(sentiment, 'neutral') AS c, count(*) AS n FROM flagged WHERE processed_at IS NOT NULL
     GROUP BY 1)) AS sentiment_distribution
FROM flagged WHERE processed_at IS NOT NULL HAVING count(*) > 0"""))
def q_classification_summary(spark, sf):
    from chorus.operators.reports import classification_summary
    c = classification_summary(flagged(spark, sf, {}))
    return c.withColumns({c_: r6(c_) for c_ in ["average_confidence", "classification_rate"]})


@query("category_insights", _rep("""
SELECT primary_category AS category, count(*) AS review_count,
  count(*) FILTER (WHERE coalesce(sentiment, 'neutral') = 'positive') AS positive_count,
  count(*) FILTER (WHERE coalesce(sentiment, 'neutral') = 'negative') AS negative_count,
  count(*) FILTER (WHERE coalesce(sentiment, 'neutral') = 'neutral') AS neutral_count,
  round(avg(CAST(coalesce(rating, 0) AS DOUBLE)), 6) AS average_rating,
  round(avg(coalesce(sentiment_score, 0.0)), 6) AS average_sentiment_score
FROM flagged WHERE processed_at IS NOT NULL AND primary_category IS NOT NULL GROUP BY primary_category"""))
def q_category_insights(spark, sf):
    from chorus.operators.reports import category_insights
    c = category_insights(flagged(spark, sf, {}))
    return c.withColumns({c_: r6(c_) for c_ in ["average_rating", "average_sentiment_score"]})


@query("category_keywords_topk", _rep("""
SELECT category, rank, keyword, count FROM (
  SELECT category, keyword, count, row_number() OVER (PARTITION BY category ORDER BY count DESC, first_ord, keyword) AS rank
  FROM (SELECT primary_category AS category, kw AS keyword, count(*) AS count, min(ord) AS first_ord
        FROM (SELECT primary_category, ord, unnest(string_split(keywords, ',')) AS kw FROM flagged
              WHERE processed_at IS NOT NULL AND primary_category IS NOT NULL AND keywords <> '')
        GROUP BY ALL))
WHERE rank <= 10"""))
def q_category_keywords_topk(spark, sf):
    from chorus.operators.reports import category_keywords_topk
    return category_keywords_topk(flagged(spark, sf, {}))


@query("category_samples", _rep("""
SELECT category, rank, ord, content, rating, sentiment FROM (
  SELECT primary_category AS category, row_number() OVER (PARTITION BY primary_category ORDER BY ord) AS rank, ord,
    CASE WHEN length(content) > 200 THEN concat(substr(content, 1, 200), '...') ELSE content END AS content,
    rating, sentiment
  FROM flagged WHERE processed_at IS NOT NULL AND primary_category IS NOT NULL)
WHERE rank <= 3"""))
def q_category_samples(spark, sf):
    from chorus.operators.reports import category_samples
    return category_samples(flagged(spark, sf))


@query("category_analysis", _rep("""
SELECT primary_category AS category, count(*) AS count, round(avg(coalesce(sentiment_score, 0.0)), 6) AS average_sentiment,
  round(coalesce(avg(CAST(rating AS DOUBLE)) FILTER (WHERE rating IS NOT NULL AND rating <> 0), 0.0), 6) AS average_rating
FROM flagged WHERE processed_at IS NOT NULL AND primary_category IS NOT NULL AND primary_category <> 'unclassified'
GROUP BY primary_category"""))
def q_category_analysis(spark, sf):
    from chorus.operators.reports import category_analysis
    c = category_analysis(flagged(spark, sf, {}))
    return c.withColumns({c_: r6(c_) for c_ in ["average_sentiment", "average_rating"]})


@query("sentiment_by_grouping_sets", _rep("""
SELECT CASE WHEN grouping(platform) = 0 THEN 'platform' ELSE 'app' END AS dimension,
  coalesce(CASE WHEN grouping(platform) = 0 THEN platform END, app_name) AS key,
  round(avg(coalesce(sentiment_score, 0.0)), 6) AS average_sentiment, count(*) AS reviews
FROM flagged WHERE processed_at IS NOT NULL GROUP BY GROUPING SETS ((platform), (app_name))"""))
def q_sentiment_by_grouping_sets(spark, sf):
    from chorus.operators.reports import sentiment_by_grouping_sets
    return sentiment_by_grouping_sets(flagged(spark, sf, {})).withColumn("average_sentiment", r6("average_sentiment"))


@query("quality_metrics", _rep("""
SELECT count(*) AS total_reviews, count(*) FILTER (WHERE is_spam) AS spam_count,
  count(*) FILTER (WHERE is_duplicate) AS duplicate_count, count(*) FILTER (WHERE is_high_quality) AS high_quality_count,
  round((count(*) FILTER (WHERE is_spam))::DOUBLE / count(*), 6) AS spam_rate,
  round((count(*) FILTER (WHERE is_duplicate))::DOUBLE / count(*), 6) AS duplicate_rate,
  round((count(*) FILTER (WHERE is_high_quality))::DOUBLE / count(*), 6) AS quality_rate
FROM flagged"""))
def q_quality_metrics(spark, sf):
    from chorus.operators.reports import quality_metrics
    q = quality_metrics(flagged(spark, sf, {}))
    return q.withColumns({c: r6(c) for c in ["spam_rate", "duplicate_rate", "quality_rate"]})


@query("insights", _rep("""
SELECT * FROM (
  SELECT 'highest_rated_app' AS kind, app_name AS subject, round(avg_rating, 6) AS value FROM (
    SELECT app_name, arg_max(avg_rating, batch_ord) AS avg_rating, min(batch_ord) AS first_ord FROM (
      SELECT app_name, platform, min(ord) AS batch_ord,
        coalesce(avg(CAST(rating AS DOUBLE)) FILTER (WHERE processed_at IS NOT NULL AND rating IS NOT NULL
                 AND rating <> 0), 0.0) AS avg_rating
      FROM flagged GROUP BY app_name, platform)
    WHERE avg_rating > 0 GROUP BY app_name)
  ORDER BY avg_rating DESC, first_ord LIMIT 1)
UNION ALL
SELECT * FROM (
  SELECT 'most_discussed_category' AS kind, primary_category AS subject, CAST(count(*) AS DOUBLE) AS value
  FROM flagged WHERE processed_at IS NOT NULL AND primary_category IS NOT NULL AND primary_category <> 'unclassified'
  GROUP BY primary_category ORDER BY count(*) DESC, min(ord) LIMIT 1)"""))
def q_insights(spark, sf):
    from chorus.operators.reports import insights
    return insights(flagged(spark, sf, {})).withColumn("value", r6("value"))


@query("funnel", _rep("""
SELECT c.app_name, c.platform, c.original, c.cleaned,
  coalesce(f.after_hash, 0) AS after_hash, coalesce(f.after_similarity, 0) AS after_similarity,
  coalesce(f.after_spam, 0) AS after_spam, coalesce(f.deduplicated, 0) AS deduplicated,
  coalesce(f.classified, 0) AS classified, coalesce(f.final, 0) AS final,
  round(coalesce(f.final, 0)::DOUBLE / c.original, 6) AS processing_rate
FROM (SELECT app_name, platform, count(*) AS original, count(*) FILTER (WHERE drop_reason IS NULL) AS cleaned
      FROM cleaned GROUP BY ALL) c
LEFT JOIN (SELECT app_name, platform,
      count(*) FILTER (WHERE stage <> 'hash_duplicate') AS after_hash,
      count(*) FILTER (WHERE stage NOT IN ('hash_duplicate', 'near_duplicate')) AS after_similarity,
      count(*) FILTER (WHERE stage NOT IN ('hash_duplicate', 'near_duplicate', 'spam')) AS after_spam,
      count(*) FILTER (WHERE stage = 'kept') AS deduplicated,
      count(*) FILTER (WHERE stage = 'kept' AND primary_category IS NOT NULL) AS classified,
      count(*) FILTER (WHERE stage = 'kept') AS final
      FROM flagged GROUP BY ALL) f USING (app_name, platform)"""))
def q_funnel(spark, sf):
    from chorus.operators.reports import funnel
    return funnel(cleaned(spark, sf), flagged(spark, sf, {})).withColumn("processing_rate", r6("processing_rate"))


@query("cleaning_stats", S.with_base("""
SELECT count(*) AS original_count, count(*) FILTER (WHERE drop_reason IS NULL) AS cleaned_count,
  count(*) - count(*) FILTER (WHERE drop_reason IS NULL) AS removed_count,
  round((count(*) - count(*) FILTER (WHERE drop_reason IS NULL))::DOUBLE / count(*), 6) AS removal_rate,
  round((SELECT coalesce(avg((o.orig_len - v.cleaned_length)::DOUBLE / o.orig_len), 0.0)
   FROM cleaned v JOIN (SELECT review_id, arg_max(length(coalesce(raw_content, '')), ord) AS orig_len
                        FROM cleaned GROUP BY review_id) o USING (review_id)
   WHERE v.drop_reason IS NULL AND o.orig_len > 0), 6) AS average_length_reduction
FROM cleaned"""))
def q_cleaning_stats(spark, sf):
    from chorus.operators.reports import cleaning_stats
    c = cleaning_stats(cleaned(spark, sf))
    return c.withColumns({c_: r6(c_) for c_ in ["removal_rate", "average_length_reduction"]})


@query("length_reduction_join", S.with_base("""
SELECT v.ord, v.review_id, o.orig_len, v.cleaned_length,
  round(CASE WHEN o.orig_len > 0 THEN (o.orig_len - v.cleaned_length)::DOUBLE / o.orig_len END, 6) AS reduction
FROM cleaned v JOIN (SELECT review_id, arg_max(length(coalesce(raw_content, '')), ord) AS orig_len
                     FROM cleaned GROUP BY review_id) o USING (review_id)
WHERE v.drop_reason IS NULL"""))
def q_length_reduction_join(spark, sf):
    from chorus.operators.reports import length_reduction
    return length_reduction(cleaned(spark, sf)).withColumn("reduction", r6("reduction"))


@query("dedup_stats", _rep("""
SELECT count(*) AS original_count, count(*) FILTER (WHERE stage = 'kept') AS final_count,
  count(*) - count(*) FILTER (WHERE stage = 'kept') AS removed_count,
  round((count(*) - count(*) FILTER (WHERE stage = 'kept'))::DOUBLE / count(*), 6) AS removal_rate,
  0.9 AS similarity_threshold
FROM flagged"""))
def q_dedup_stats(spark, sf):
    from chorus.operators.reports import dedup_stats
    return dedup_stats(flagged(spark, sf, {})).withColumn("removal_rate", r6("removal_rate"))


@query("theme_brief", _rep("""
SELECT section, key, round(n::DOUBLE / sum(n) OVER (PARTITION BY section), 6) AS share, NULL::VARCHAR AS text FROM (
  SELECT 'category' AS section, coalesce(primary_category, 'unclassified') AS key, count(*) AS n
  FROM flagged WHERE processed_at IS NOT NULL GROUP BY 2
  UNION ALL
  SELECT 'sentiment', coalesce(sentiment, 'neutral'), count(*) FROM flagged WHERE processed_at IS NOT NULL GROUP BY 2)
UNION ALL
SELECT 'quote', CAST(row_number() OVER (ORDER BY length(content), ord) AS VARCHAR), NULL::DOUBLE, content FROM (
  SELECT content, min(ord) AS ord FROM flagged WHERE processed_at IS NOT NULL GROUP BY content
  ORDER BY length(content), ord LIMIT 3)"""))
def q_theme_brief(spark, sf):
    from chorus.operators.reports import theme_brief
    return theme_brief(flagged(spark, sf)).withColumn("share", r6("share"))


# ------------------------------------------------------------------ flagship (entry)
@query("app_sentiment_mix", S.with_base("""
SELECT app_name, count(*) AS reviews,
  count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
  count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
  round(avg(CAST(rating AS DOUBLE)), 6) AS average_rating, round(avg(sentiment_score), 6) AS average_sentiment
FROM (SELECT * FROM mix_cls) GROUP BY app_name""", S.classify_ctes("hd", "mix_cls").replace(
    "mix_cls_a AS", "hd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_name, platform, content_hash "
    "ORDER BY ord) AS _rn FROM valid) WHERE _rn = 1),\nmix_cls_a AS", 1)))
def q_app_sentiment_mix(spark, sf):
    """Minimum slice: clean -> valid -> exact de-dup -> sentiment -> per-app mix."""
    hd = hash_dedup(valid(spark, sf))
    c = classify(hd, TEST_SETTINGS["lexicon"], TEST_SETTINGS["positive"], TEST_SETTINGS["negative"], as_of=AS_OF)
    return c.groupBy("app_name").agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count(F.when(F.col("sentiment") == "positive", 1)).alias("positive"),
        F.count(F.when(F.col("sentiment") == "negative", 1)).alias("negative"),
        F.count(F.when(F.col("sentiment") == "neutral", 1)).alias("neutral"),
        r6(F.avg(F.col("rating").cast("double"))).alias("average_rating"),
        r6(F.avg("sentiment_score")).alias("average_sentiment"))


# ------------------------------------------------------------------ near-duplicates (no SQL: difflib ratio)
def _nd_stage(spark, sf, name):
    """Stage tables of a query: a changed input, or other settings of cleaning, have tables of their own."""
    from chorus.plans.store import input_stamp, stage_table
    key = f"nd|{input_stamp(spark, f'{sf}/documents.parquet')}|{AS_OF}|{sorted(vars(Settings()).items())}|{name}"
    return lambda n, build: stage_table(spark, f"{key}|{n}", build)


@query("near_dup_pairs")
def q_near_dup_pairs(spark, sf):
    """Verified (later, earlier, similarity) edges, batch = app_name."""
    from chorus.operators.neardup import similar_pairs
    return similar_pairs(valid(spark, sf), ["app_name"], stage=_nd_stage(spark, sf, "pairs")).select("later", "earlier", r6("similarity").alias("similarity"))


@query("near_dup_clusters")
def q_near_dup_clusters(spark, sf):
    from chorus.operators.neardup import near_duplicate_clusters
    return near_duplicate_clusters(valid(spark, sf), ["app_name"], stage=_nd_stage(spark, sf, "clusters")).select(
        "app_name", "ord", "cluster")


@query("pipeline_full")
def q_pipeline_full(spark, sf):
    """All four de-dup stages including near-duplicates, per (app, platform)."""
    from chorus.plans.pipeline import documents_pipeline
    return documents_pipeline(spark, sf, near_dup=True, texts={}).select("ord", "app_name", "platform", "stage",
                                                                          "primary_category", "sentiment")


# ------------------------------------------------------------------ landed API responses (1.8-1.10, 6.2, 4.18, 7.1)
def api_responses(spark, sf) -> DataFrame:
    """conversations -> landed API response JSON (one response per turn), built by Spark."""
    from chorus.sources.testdata import read_table
    c = read_table(spark, sf, "conversations")
    review = F.struct(
        F.when(F.col("turn") % 2 == 0, F.lit("https://apps.apple.com/us/app/x"))
         .otherwise(F.lit("https://play.google.com/store/apps/details?id=x")).alias("query"),
        F.col("conv_id").cast("string").alias("review_id"),
        F.concat((F.lit(1) + F.col("turn") % 5).cast("string"), F.lit(".7 stars")).alias("review_rating"),
        F.lit("").alias("review_title"),
        F.when(((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0)) | (F.col("turn") % 3 == 2), F.lit(""))
         .otherwise(F.col("text")).alias("review_text"),
        F.lit(None).cast("string").alias("author_title"),
        F.col("role").alias("author_name"),
        F.lit("").alias("review_updated"),
        F.concat(F.lit("2024-01-"), F.lpad((F.lit(1) + F.col("conv_id") % 28).cast("string"), 2, "0"))
         .alias("review_date_formated"),
        F.col("turn").cast("string").alias("vote_sum"),
        F.lit(None).cast("string").alias("vote_count"),
        F.lit("1.0").alias("version"),
        F.lit("us").alias("country"),
        (F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).cast("long").alias("review_timestamp"))
    status = F.when(F.col("role") == "system", F.lit("Pending")).otherwise(F.lit("Success"))
    arr_form = F.to_json(F.array(F.struct(status.alias("status"), F.array(F.array(review)).alias("data"))))
    obj_form = F.to_json(F.struct(status.alias("status"), F.array(review).alias("data")))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("ord"),
                    F.concat(F.lit("app"), (F.col("conv_id") % 3).cast("string")).alias("app_name"),
                    F.when(F.col("conv_id") % 7 == 3, obj_form).otherwise(arr_form).alias("body"))


_API_SQL = """
WITH api AS (
  SELECT conv_id * 100 + turn AS ord, 'app' || CAST(conv_id % 3 AS VARCHAR) AS app_name,
    CASE WHEN turn % 2 = 0 THEN 'iOS App Store' ELSE 'Google Play Store' END AS platform,
    CAST(conv_id AS VARCHAR) AS review_id, CAST(1 + turn % 5 AS BIGINT) AS rating, '' AS title,
    CASE WHEN (conv_id % 5 = 0 AND turn = 0) OR turn % 3 = 2 THEN '' ELSE coalesce(text, '') END AS review_text,
    coalesce(nullif(role, ''), '') AS author,
    '2024-01-' || lpad(CAST(1 + conv_id % 28 AS VARCHAR), 2, '0') AS date,
    CAST(turn AS BIGINT) AS helpful_count, CAST(0 AS BIGINT) AS vote_count, '1.0' AS version, 'us' AS country,
    CAST(1704067200 + conv_id * 60 + turn AS BIGINT) AS timestamp
  FROM conversations WHERE role <> 'system'),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id, platform ORDER BY ord) AS rn FROM api)
  WHERE rn = 1 AND regexp_replace(review_text, '[\\t-\\r\\x1c-\\x20\\x85\\p{Z}]', '', 'g') <> '')
"""


def api_first(spark, sf) -> DataFrame:
    from chorus.sources.landed import first_then_nonempty, flatten_api_responses
    flat = flatten_api_responses(api_responses(spark, sf))
    return first_then_nonempty(flat)


@query("api_flatten_first", _API_SQL + """
SELECT app_name, platform, review_id, rating, title, review_text, author, date, helpful_count, vote_count,
  version, country, timestamp FROM firsts""")
def q_api_flatten_first(spark, sf):
    return api_first(spark, sf).select("app_name", "platform", "review_id", "rating", "title", "review_text",
                                       "author", "date", "helpful_count", "vote_count", "version", "country",
                                       "timestamp")


@query("newest_first_topk", _API_SQL + """
SELECT row_number() OVER (ORDER BY timestamp DESC, ord) AS rank, review_id, platform, timestamp
FROM (SELECT * FROM firsts ORDER BY timestamp DESC, ord LIMIT 20)""")
def q_newest_first_topk(spark, sf):
    """Top 20 newest (a top-k report): timestamp if set, else parsed date; ties by ingest order."""
    from pyspark.sql import Window
    from chorus.operators.select import newest_first
    top = newest_first(api_first(spark, sf)).limit(20)
    return top.select(F.row_number().over(Window.orderBy(F.desc("newest_key"), "ord")).alias("rank"), "review_id",
                      "platform", "timestamp")


@query("newest_first", _API_SQL + """
SELECT review_id, platform, timestamp AS newest_key FROM firsts ORDER BY timestamp DESC, ord""")
def q_newest_first(spark, sf):
    """All first occurrences, newest first."""
    from chorus.operators.select import newest_first
    return newest_first(api_first(spark, sf)).select("review_id", "platform", "newest_key")


# ------------------------------------------------------------------ forum threads (1.12, 1.13, 3.4, 4.4, 4.5, 10.17, 10.18)
_FORUM_SQL = """
WITH posts AS (SELECT CAST(conv_id AS VARCHAR) AS id, 'user' || CAST(conv_id % 50 AS VARCHAR) AS author,
    substr(text, 1, 60) AS title, text AS selftext, conv_id % 40 AS score,
    1704067200 + conv_id * 3600 AS created_utc, '/r/src/comments/' || CAST(conv_id AS VARCHAR) AS permalink
  FROM conversations WHERE turn = 0),
comments AS (SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS parent_id,
    CASE WHEN role = 'system' THEN NULL ELSE role END AS author, text AS body, turn * 2 AS score
  FROM conversations WHERE turn > 0)
"""


@query("comment_parent_join", _FORUM_SQL + """
SELECT 'reddit_comment_' || c.id AS review_id, p.id AS parent_post_id,
  'Comment on: ' || substr(p.title, 1, 50) || '...' AS title, coalesce(c.author, 'deleted') AS user_id
FROM comments c JOIN posts p ON c.parent_id = p.id""")
def q_comment_parent_join(spark, sf):
    from chorus.sources.forum import comments_with_parent
    from chorus.sources.testdata import forum_threads
    posts, comments = forum_threads(spark, sf)
    return comments_with_parent(comments, posts).select("review_id", "parent_post_id", "title", "user_id")


@query("relevance_filter", _FORUM_SQL + """
SELECT 'post' AS kind, id FROM posts WHERE contains(lower(title || ' ' || selftext), 'tion')
  OR contains(lower(title || ' ' || selftext), 'ing')
UNION ALL
SELECT 'comment', id FROM comments WHERE (contains(lower(body), 'tion') OR contains(lower(body), 'ing'))
  AND length(body) > 20""")
def q_relevance_filter(spark, sf):
    from chorus.lexicons import TEST_RELEVANCE_KEYWORDS as KW
    from chorus.sources.forum import relevant_comments, relevant_posts
    from chorus.sources.testdata import forum_threads
    posts, comments = forum_threads(spark, sf)
    return (relevant_posts(posts, KW).select(F.lit("post").alias("kind"), "id")
            .unionByName(relevant_comments(comments, KW).select(F.lit("comment").alias("kind"), "id")))


def _simple_sql(expr: str) -> str:
    pos = " + ".join(f"CAST(contains(lower({expr}), '{w}') AS INTEGER)" for w in ["that", "this", "is"])
    neg = " + ".join(f"CAST(contains(lower({expr}), '{w}') AS INTEGER)" for w in ["from", "at", "on"])
    n = f"len({S.ws_words(expr)})"
    return (f"(CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, "
            f"(({pos}) - ({neg}))::DOUBLE / greatest({n}, 1) * 10)) END)")


@query("forum_posts_canonical", _FORUM_SQL + f"""
SELECT 'reddit_post_' || id AS review_id, coalesce(author, 'deleted') AS user_id, title, selftext AS content,
  round(s, 6) AS sentiment_score,
  CASE WHEN s >= 0.5 THEN 5 WHEN s >= 0.2 THEN 4 WHEN s >= -0.2 THEN 3 WHEN s >= -0.5 THEN 2 ELSE 1 END AS rating,
  strftime(make_timestamp(CAST(created_utc AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') AS review_date,
  score AS helpful_count, 'https://reddit.com' || permalink AS source_url
FROM (SELECT *, {_simple_sql("title || ' ' || selftext")} AS s FROM posts)
WHERE contains(lower(title || ' ' || selftext), 'tion') OR contains(lower(title || ' ' || selftext), 'ing')""")
def q_forum_posts_canonical(spark, sf):
    from chorus import lexicons as LX
    from chorus.sources.forum import normalize_posts
    from chorus.sources.testdata import forum_threads
    posts, _ = forum_threads(spark, sf)
    p = normalize_posts(posts, "documents", LX.TEST_RELEVANCE_KEYWORDS, list(LX.TEST_POSITIVE_WEIGHTS),
                        list(LX.TEST_NEGATIVE_WEIGHTS))
    return p.select("review_id", "user_id", "title", "content", r6("sentiment_score").alias("sentiment_score"),
                    "rating", "review_date", "helpful_count", "source_url")


@query("word_jaccard", _FORUM_SQL + f"""
SELECT c.id, round(CASE WHEN coalesce(c.body, '') = '' OR coalesce(p.selftext, '') = '' THEN 0.0
  WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0
  ELSE len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 6)
  AS jaccard
FROM (SELECT *, {S.ws_words('lower(body)')} AS a FROM comments) c
JOIN (SELECT *, {S.ws_words('lower(selftext)')} AS b FROM posts) p ON c.parent_id = p.id""")
def q_word_jaccard(spark, sf):
    from chorus.sources.testdata import forum_threads
    posts, comments = forum_threads(spark, sf)
    j = comments.join(posts.select(F.col("id").alias("parent_id"), "selftext"), "parent_id")
    return j.select("id", r6(T.word_jaccard("body", "selftext")).alias("jaccard"))


# ------------------------------------------------------------------ budgets, samples, bullets (6.6, 7.7, 6.8, 10.23, 10.24)
@query("source_budget", """
SELECT source, ord FROM (
  SELECT source, doc_id AS ord FROM documents
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 200 // (SELECT count(DISTINCT source) FROM documents))
ORDER BY ord LIMIT 200""")
def q_source_budget(spark, sf):
    from chorus.operators.select import per_group_budget
    from chorus.sources.testdata import read_table
    d = read_table(spark, sf, "documents").select("source", F.col("doc_id").alias("ord"))
    return per_group_budget(d, "source", 200)


_SAMPLE_SQL = S.with_base("""
SELECT app_name, row_number() OVER (PARTITION BY app_name ORDER BY md5('42' || review_id), ord) AS pos,
  review_id, rating, content
FROM valid QUALIFY pos <= 10""")


@query("random_sample", _SAMPLE_SQL.replace("review_id, rating, content\nFROM", "ord, review_id\nFROM"))
def q_random_sample(spark, sf):
    from chorus.operators.select import seeded_sample
    return seeded_sample(valid(spark, sf), "app_name", "review_id", 10, seed="42").select(
        "app_name", "pos", "ord", "review_id")


@query("bullets", f"""
WITH s AS ({_SAMPLE_SQL})
SELECT app_name, count(*) AS count,
  string_agg('- [' || CAST(pos AS VARCHAR) || ']' || CASE WHEN rating IS NOT NULL THEN ' ★' || CAST(rating AS VARCHAR) ELSE '' END
    || ': ' || CASE WHEN length(coalesce(content, '')) > 600 THEN substr(content, 1, 597) || '...' ELSE coalesce(content, '') END,
    chr(10) ORDER BY pos) AS bullets,
  'content' AS text_key
FROM s GROUP BY app_name""")
def q_bullets(spark, sf):
    from chorus.operators.select import bullets, seeded_sample
    s = seeded_sample(valid(spark, sf), "app_name", "review_id", 10, seed="42").select(
        "app_name", "pos", "review_id", "rating", "content")
    return bullets(s, "app_name")


# ------------------------------------------------------------------ scalar normalisers on events (10.3-10.5, 4.17)
@query("normalize_rating", """
SELECT event_id, CAST(greatest(1, least(5, CAST(round_even(value, 0) AS DOUBLE))) AS INTEGER) AS rating,
  CAST(greatest(1, least(5, CAST(round_even(value / 40, 0) AS DOUBLE))) AS INTEGER) AS rating_scaled
FROM events""")
def q_normalize_rating(spark, sf):
    from pyspark.sql.types import DoubleType
    from chorus.functions.normalize import normalize_rating
    from chorus.sources.testdata import read_table
    e = read_table(spark, sf, "events")
    return e.select("event_id", normalize_rating(F.col("value").cast("string")).alias("rating"),
                    normalize_rating(F.col("value") / 40, DoubleType()).alias("rating_scaled"))


@query("normalize_count", """
SELECT event_id, greatest(0, CAST(trunc(value - 10) AS BIGINT)) AS count FROM events""")
def q_normalize_count(spark, sf):
    from pyspark.sql.types import DoubleType
    from chorus.functions.normalize import normalize_count
    from chorus.sources.testdata import read_table
    e = read_table(spark, sf, "events")
    return e.select("event_id", normalize_count(F.col("value") - 10, DoubleType()).alias("count"))


_DATE_RAW_SQL = """CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d')
  WHEN 2 THEN strftime(ts, '%m/%d/%Y') ELSE strftime(ts, '%d/%m/%Y') END"""


@query("normalize_date", f"""
SELECT event_id, raw, {S.norm_date('raw')} AS review_date FROM (SELECT event_id, {_DATE_RAW_SQL} AS raw FROM events)""")
def q_normalize_date(spark, sf):
    from chorus.functions.normalize import normalize_date
    from chorus.sources.testdata import read_table
    e = read_table(spark, sf, "events")
    k = F.col("event_id") % 4
    raw = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy-MM-dd"))
           .when(k == 2, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.date_format("ts", "dd/MM/yyyy")))
    return e.select("event_id", raw.alias("raw")).select("event_id", "raw", normalize_date("raw").alias("review_date"))


@query("date_range_filter", """
SELECT event_id, event_type FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'""")
def q_date_range_filter(spark, sf):
    from chorus.operators.select import date_range_filter
    from chorus.sources.testdata import read_table
    e = read_table(spark, sf, "events")
    return date_range_filter(e, "ts", "last_7_days", now="2024-01-31T00:00:00").select("event_id", "event_type")


# ------------------------------------------------------------------ record projections and chunks (4.15, 2.6, 6.5)
@query("record_preview", _rep("""
SELECT review_id, platform, app_name, rating, sentiment, primary_category,
  CASE WHEN length(coalesce(nullif(content, ''), raw_content)) > 100
       THEN substr(coalesce(nullif(content, ''), raw_content), 1, 100) || '...'
       ELSE coalesce(nullif(content, ''), raw_content) END AS content_preview,
  review_date, is_high_quality, helpful_count
FROM flagged"""))
def q_record_preview(spark, sf):
    from chorus.operators.select import content_preview, record_summary
    return record_summary(flagged(spark, sf, {"content_preview": content_preview()}))


@query("summary_rows", _rep("""
SELECT app_name, platform, count(*) AS total_reviews, count(*) FILTER (WHERE is_high_quality) AS high_quality_reviews,
  CAST(round_even(coalesce(avg(CAST(rating AS DOUBLE)) FILTER (WHERE processed_at IS NOT NULL AND rating IS NOT NULL
        AND rating <> 0), 0.0) * 100, 0) AS DOUBLE) / 100 AS average_rating,
  CAST(round_even(coalesce(avg(sentiment_score) FILTER (WHERE processed_at IS NOT NULL), 0.0) * 1000, 0) AS DOUBLE) / 1000
    AS average_sentiment_score,
  count(*) FILTER (WHERE processed_at IS NOT NULL AND coalesce(sentiment, 'neutral') = 'positive') AS positive_sentiment_count,
  count(*) FILTER (WHERE processed_at IS NOT NULL AND coalesce(sentiment, 'neutral') = 'negative') AS negative_sentiment_count,
  count(*) FILTER (WHERE processed_at IS NOT NULL AND coalesce(sentiment, 'neutral') = 'neutral') AS neutral_sentiment_count
FROM flagged GROUP BY app_name, platform"""))
def q_summary_rows(spark, sf):
    from chorus.sinks.export import summary_rows
    return summary_rows(flagged(spark, sf, {}))


@query("chunk_numbers", S.with_base("""
SELECT ord, app_name, platform, (row_number() OVER (PARTITION BY app_name, platform ORDER BY ord) - 1) // 100 AS chunk
FROM valid"""))
def q_chunk_numbers(spark, sf):
    from chorus.operators.chunks import chunk_numbers
    return chunk_numbers(valid(spark, sf), ["app_name", "platform"], 100).select("ord", "app_name", "platform", "chunk")


# ------------------------------------------------------------------ store dump, CSV cells, flattening (1.11, 2.2, 10.26)
@query("store_reviews_canonical", """
SELECT 'playstore_' || ('doc_' || CAST(doc_id AS VARCHAR)) AS review_id, 'playstore' AS platform, lang AS app_name,
  'doc_' || CAST(doc_id AS VARCHAR) AS user_id,
  CAST(CASE WHEN doc_id % 7 = 6 THEN 0 ELSE 1 + doc_id % 5 END AS INTEGER) AS rating,
  length(text) AS content_length, CAST(doc_id % 23 AS BIGINT) AS helpful_count, true AS verified,
  'en' AS language, 'us' AS country,
  CASE WHEN doc_id % 7 = 6 THEN 'rating_out_of_range' END AS reject_reason
FROM documents""")
def q_store_reviews_canonical(spark, sf):
    from chorus.sources.landed import normalize_store_reviews, reject_reason
    from chorus.sources.testdata import read_table
    d = read_table(spark, sf, "documents")
    dump = d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("reviewId"),
                    F.col("lang"), F.lit("someone").alias("userName"),
                    F.when(F.col("doc_id") % 7 == 6, F.lit(None)).otherwise(F.lit(1) + F.col("doc_id") % 5)
                     .cast("double").alias("score"),
                    F.col("text").alias("content"), F.lit("2024-01-01 00:00:00").alias("at"),
                    (F.col("doc_id") % 23).alias("thumbsUpCount"), F.lit("1.0").alias("appVersion"))
    rows = normalize_store_reviews(dump, F.col("lang"))
    return rows.select("review_id", "platform", "app_name", "user_id", "rating",
                       F.length("content").alias("content_length"), "helpful_count", "verified", "language",
                       "country", reject_reason().alias("reject_reason"))


@query("csv_cells", _rep("""
SELECT review_id, coalesce(CAST(rating AS VARCHAR), '') AS rating,
  CASE WHEN verified THEN 'True' WHEN NOT verified THEN 'False' ELSE '' END AS verified,
  coalesce(user_id, '') AS user_id, CAST(helpful_count AS VARCHAR) AS helpful_count,
  CASE WHEN keywords = '' THEN '[]' ELSE '["' || replace(keywords, ',', '","') || '"]' END AS keywords_found
FROM flagged"""))
def q_csv_cells(spark, sf):
    from chorus.sinks.export import csv_cells
    return csv_cells(flagged(spark, sf), ["review_id", "rating", "verified", "user_id", "helpful_count",
                                          "keywords_found"])


@query("flatten_struct", """
SELECT event_id, event_type AS "e.event_type", value AS "e.metrics.value",
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS "e.metrics.props.k" FROM events""")
def q_flatten_struct(spark, sf):
    from chorus.sources.landed import flatten_struct
    from chorus.sources.testdata import read_table
    e = read_table(spark, sf, "events")
    nested = e.select("event_id", F.struct("event_type", F.struct(
        "value", F.from_json("props", "k BIGINT").alias("props")).alias("metrics")).alias("e"))
    return flatten_struct(nested)


# ------------------------------------------------------------------ records, overlays, sources into the pipeline
@query("record_json", S.with_base("""
SELECT ord, review_id, platform, app_name, content, rating, helpful_count, 0 AS n_keywords,
       CASE WHEN rating IS NOT NULL AND (rating < 1 OR rating > 5) THEN 'rating_out_of_range' END AS reject_reason
FROM reviews"""))
def q_record_json(spark, sf):
    """Records to JSON text and back."""
    from chorus.sources.landed import canonical, records_from_json, records_to_json, reject_reason
    texts = records_to_json(canonical(reviews(spark, sf))).select("ord", "json")
    return records_from_json(texts).select("ord", "review_id", "platform", "app_name", "content", "rating", "helpful_count",
                                           F.size("keywords_found").alias("n_keywords"),
                                           reject_reason().alias("reject_reason"))


@query("clean_text_simple", S.with_base(f"""
SELECT ord, coalesce({S.strip(S.rr(S.rr('content', S.WS + '+', ' '), S.DROP_SPECIAL_RE, ''))}, '') AS simple FROM reviews"""))
def q_clean_text_simple(spark, sf):
    return reviews(spark, sf).select("ord", T.clean_text_simple("content").alias("simple"))


@query("normalized_text", S.with_base(f"SELECT ord, {S.norm_compare('content')} AS norm_content FROM valid"))
def q_normalized_text(spark, sf):
    """The text that the similarity compares."""
    return valid(spark, sf).select("ord", T.normalize_for_comparison("content").alias("norm_content"))


@query("overlay_labels", """
SELECT d.doc_id, coalesce(CASE l.toxic WHEN 1 THEN 'negative' WHEN 0 THEN 'positive' END, 'neutral') AS sentiment,
  CASE WHEN l.doc_id IS NOT NULL THEN '2025-01-01T00:00:00' END AS processed_at
FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)""")
def q_overlay_labels(spark, sf):
    """Sentiments from ``labels`` laid over neutral ones."""
    from chorus.sources.landed import overlay
    from chorus.sources.testdata import read_table
    base = read_table(spark, sf, "documents").select(
        "doc_id", F.lit("neutral").alias("sentiment"), F.lit(None).cast("string").alias("processed_at"))
    updates = read_table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "negative").when(F.col("toxic") == 0, "positive").alias("sentiment"),
        F.col("toxic").alias("ord"))
    return overlay(base, updates, "doc_id", AS_OF).select("doc_id", "sentiment", "processed_at")


@query("generic_hash", """
SELECT doc_id, md5(text) AS text_hash, md5('["' || lang || '", "' || source || '"]') AS list_hash,
  md5('{"lang": "' || lang || '", "source": "' || source || '"}') AS map_hash FROM documents""")
def q_generic_hash(spark, sf):
    from chorus.sources.landed import generic_hash
    from chorus.sources.testdata import read_table
    d = read_table(spark, sf, "documents").select(
        "doc_id", "text", F.array("lang", "source").alias("l"),
        F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")).alias("m"))
    return d.select("doc_id", generic_hash(d, "text").alias("text_hash"), generic_hash(d, "l").alias("list_hash"),
                    generic_hash(d, "m").alias("map_hash"))


@query("forum_comments_canonical", _FORUM_SQL + f"""
SELECT 'reddit_comment_' || id AS review_id, coalesce(author, 'deleted') AS user_id, title, content,
  CASE WHEN s >= 0.5 THEN 5 WHEN s >= 0.2 THEN 4 WHEN s >= -0.2 THEN 3 WHEN s >= -0.5 THEN 2 ELSE 1 END AS rating,
  review_date, helpful_count
FROM (SELECT c.id, c.author, 'Comment on: ' || substr(p.title, 1, 50) || '...' AS title, c.body AS content,
        {_simple_sql("c.body")} AS s, c.score AS helpful_count,
        strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%S') AS review_date
      FROM (SELECT *, split_part(id, '_', 1)::BIGINT AS conv_id, split_part(id, '_', 2)::BIGINT AS turn,
              row_number() OVER (PARTITION BY parent_id ORDER BY split_part(id, '_', 2)::BIGINT) AS rn FROM comments) c
      JOIN posts p ON c.parent_id = p.id
      WHERE rn <= 5 AND length(c.body) > 20 AND (contains(lower(c.body), 'tion') OR contains(lower(c.body), 'ing')))""")
def q_forum_comments_canonical(spark, sf):
    return forum_reviews(spark, sf)[1].select("review_id", "user_id", "title", "content", "rating", "review_date",
                                              "helpful_count")


def forum_reviews(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Posts and comments of ``conversations`` in the review schema."""
    from chorus import lexicons as LX
    from chorus.sources.forum import normalize_comments, normalize_posts
    from chorus.sources.testdata import forum_threads
    posts, comments = forum_threads(spark, sf)
    words = (LX.TEST_RELEVANCE_KEYWORDS, list(LX.TEST_POSITIVE_WEIGHTS), list(LX.TEST_NEGATIVE_WEIGHTS))
    return (normalize_posts(posts, "documents", words[0], words[1], words[2]),
            normalize_comments(comments, posts, "documents", words[0], positive=words[1], negative=words[2]))


@query("collected_sources", _FORUM_SQL.replace("WITH posts", _API_SQL.strip().removesuffix(",") + ",\nposts", 1) + """
SELECT platform, count(*) AS reviews, count(DISTINCT review_id) AS ids FROM (
  SELECT 'reddit' AS platform, 'p' || id AS review_id FROM posts
    WHERE contains(lower(title || ' ' || selftext), 'tion') OR contains(lower(title || ' ' || selftext), 'ing')
  UNION ALL SELECT 'reddit', 'c' || id FROM (SELECT *, row_number() OVER (PARTITION BY parent_id
      ORDER BY split_part(id, '_', 2)::BIGINT) AS rn FROM comments)
    WHERE rn <= 5 AND length(body) > 20 AND (contains(lower(body), 'tion') OR contains(lower(body), 'ing'))
  UNION ALL SELECT platform, review_id FROM firsts
  UNION ALL SELECT 'playstore', 'doc_' || doc_id FROM documents WHERE doc_id % 7 <> 6) GROUP BY platform""")
def q_collected_sources(spark, sf):
    """Forum posts and comments, API responses and the store dump as one input of the pipeline."""
    from chorus.sources.landed import api_reviews, normalize_store_reviews
    from chorus.sources.testdata import read_table
    from chorus.sources.union import union_reviews
    d = read_table(spark, sf, "documents")
    dump = d.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("reviewId"), "lang",
                    F.lit("someone").alias("userName"),
                    F.when(F.col("doc_id") % 7 == 6, F.lit(None)).otherwise(F.lit(1) + F.col("doc_id") % 5)
                     .cast("double").alias("score"), F.col("text").alias("content"), F.lit("2024-01-01").alias("at"),
                    F.lit(1).alias("thumbsUpCount"), F.lit("1.0").alias("appVersion"))
    posts, comments = forum_reviews(spark, sf)
    rows = union_reviews([posts, comments, api_reviews(api_first(spark, sf)), normalize_store_reviews(dump, F.col("lang"))])
    return rows.groupBy("platform").agg(F.count(F.lit(1)).alias("reviews"), F.countDistinct("review_id").alias("ids"))


@query("leaders_by_word_jaccard", S.with_base("""
SELECT ord, min(leader) AS leader FROM (
  WITH RECURSIVE rows_ AS (SELECT ord, app_name, row_number() OVER (ORDER BY ord) AS k,
      list_distinct(string_split(norm, ' ')) AS w FROM words),
  pairs AS (SELECT l.ord AS later, e.ord AS earlier FROM rows_ l JOIN rows_ e ON l.app_name = e.app_name AND l.ord > e.ord
    WHERE 10 * len(list_intersect(l.w, e.w)) >= 9 * len(list_distinct(list_concat(l.w, e.w)))),
  nodes AS (SELECT ord, row_number() OVER (ORDER BY ord) AS k
            FROM (SELECT later AS ord FROM pairs UNION SELECT earlier FROM pairs)),
  pass AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS leaders
    UNION ALL
    SELECT n.k, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.later = n.ord AND list_contains(pass.leaders, p.earlier))
                     THEN pass.leaders ELSE list_append(pass.leaders, n.ord) END
    FROM pass JOIN nodes n ON n.k = pass.k + 1),
  final AS (SELECT leaders FROM pass ORDER BY k DESC LIMIT 1)
  SELECT n.ord, n.ord AS leader FROM nodes n, final WHERE list_contains(final.leaders, n.ord)
  UNION ALL
  SELECT p.later, p.earlier FROM pairs p, final
  WHERE list_contains(final.leaders, p.earlier) AND NOT list_contains(final.leaders, p.later))
GROUP BY ord""", "words AS (SELECT ord, app_name, " + S.norm_compare("content") + " AS norm FROM valid WHERE length(content) > 0)"))
def q_leaders_by_word_jaccard(spark, sf):
    """The greedy pass over an edge rule that SQL can state: word sets with a Jaccard similarity of at least 0.9."""
    from chorus.operators.neardup import word_jaccard_leaders
    return word_jaccard_leaders(valid(spark, sf), ["app_name"], 90, _nd_stage(spark, sf, "words"))


# ------------------------------------------------------------------ report documents (2.7, 2.9), counters (5.13), briefs (9.5)
def _label_sql(name: str, value: str, where: str = "TRUE") -> str:
    return f"""coalesce((SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (
      SELECT {value} AS k, count(*) AS n FROM flagged f WHERE f.app_name IS NOT DISTINCT FROM b.app_name
        AND f.platform IS NOT DISTINCT FROM b.platform AND f.processed_at IS NOT NULL AND {where} GROUP BY 1)), '') AS {name}"""


@query("summary_report", _rep(f"""
SELECT b.*, {_label_sql("category_distribution", "coalesce(primary_category, 'unclassified')")},
  {_label_sql("sentiment_distribution", "coalesce(sentiment, 'neutral')")},
  {_label_sql("rating_distribution", "CAST(rating AS VARCHAR)", "rating IS NOT NULL AND rating <> 0")},
  (SELECT count(*) FROM flagged) AS all_reviews, count(*) OVER () AS total_batches
FROM (SELECT app_name, platform, count(*) AS total_reviews,
  count(*) FILTER (WHERE processed_at IS NOT NULL) AS processed_reviews,
  count(*) FILTER (WHERE is_spam) AS spam_reviews, count(*) FILTER (WHERE is_duplicate) AS duplicate_reviews,
  round(coalesce(avg(CAST(rating AS DOUBLE)) FILTER (WHERE processed_at IS NOT NULL AND rating IS NOT NULL
        AND rating <> 0), 0.0), 6) AS average_rating
  FROM flagged GROUP BY app_name, platform) b"""))
def q_summary_report(spark, sf):
    """The summary document, read back: one row per batch summary."""
    from chorus.operators.reports import summary_document
    doc = summary_document(flagged(spark, sf), AS_OF)
    entry = ("app_name string, platform string, total_reviews long, processed_reviews long, spam_reviews long, "
             "duplicate_reviews long, average_rating double, category_distribution map<string,long>, "
             "sentiment_distribution map<string,long>, rating_distribution map<string,long>")
    schema = (f"report_metadata struct<total_batches: long>, overall_stats struct<total_reviews: long>, "
              f"batch_summaries array<struct<{', '.join(x.replace(' ', ': ', 1) for x in entry.split(', '))}>>")
    read = doc.select(F.from_json("document", schema).alias("d"))
    rows = read.select("d.report_metadata.total_batches", F.col("d.overall_stats.total_reviews").alias("all_reviews"),
                       F.inline("d.batch_summaries"))
    shown = {c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
        for c in ("category_distribution", "sentiment_distribution", "rating_distribution")}
    return rows.withColumns(shown | {"average_rating": r6("average_rating")})


@query("analysis_report", _rep("""
SELECT 'category' AS section, primary_category AS key, CAST(count(*) AS DOUBLE) AS amount,
  round(avg(coalesce(sentiment_score, 0.0)), 6) AS average_sentiment
FROM flagged WHERE processed_at IS NOT NULL AND coalesce(primary_category, 'unclassified') <> 'unclassified' GROUP BY ALL
UNION ALL
SELECT 'platform', platform, NULL, round(avg(coalesce(sentiment_score, 0.0)), 6) FROM flagged
WHERE processed_at IS NOT NULL GROUP BY ALL
UNION ALL
SELECT 'app', app_name, NULL, round(avg(coalesce(sentiment_score, 0.0)), 6) FROM flagged
WHERE processed_at IS NOT NULL GROUP BY ALL
UNION ALL
SELECT 'quality', 'spam_count', CAST(count(*) FILTER (WHERE is_spam) AS DOUBLE), NULL FROM flagged
UNION ALL
SELECT 'insight', 'Most discussed category: ' || primary_category || ' (' || n || ' reviews)', NULL, NULL FROM (
  SELECT primary_category, count(*) AS n FROM flagged
  WHERE processed_at IS NOT NULL AND coalesce(primary_category, 'unclassified') <> 'unclassified'
  GROUP BY primary_category ORDER BY count(*) DESC, min(ord) LIMIT 1)"""))
def q_analysis_report(spark, sf):
    """The analysis document, read back as rows."""
    from chorus.operators.reports import analysis_document
    doc = analysis_document(flagged(spark, sf), AS_OF)
    schema = ("insights array<string>, category_analysis map<string, struct<count: long, average_sentiment: double>>, "
              "sentiment_trends struct<by_platform: map<string, double>, by_app: map<string, double>>, "
              "quality_metrics struct<spam_count: long>")
    d = doc.select(F.from_json("document", schema).alias("d")).select("d.*")
    none = F.lit(None).cast("double")

    def rows(section, exploded, key, amount, average):
        return exploded.select(F.lit(section).alias("section"), key.alias("key"), amount.cast("double").alias("amount"),
                               F.round(average, 6).alias("average_sentiment"))

    kv, key = F.col("value"), F.col("key")
    parts = [rows("category", d.select(F.explode("category_analysis")), key, kv["count"], kv["average_sentiment"]),
             rows("platform", d.select(F.explode("sentiment_trends.by_platform")), key, none, kv),
             rows("app", d.select(F.explode("sentiment_trends.by_app")), key, none, kv),
             rows("quality", d, F.lit("spam_count"), F.col("quality_metrics.spam_count"), none),
             rows("insight", d.select(F.explode("insights").alias("key")).where(F.col("key").startswith("Most")), key, none, none)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("batch_counters", S.with_base("""
SELECT app_name, platform, count(*) AS total_scraped,
  (SELECT count(*) FROM flagged f WHERE f.processed_at IS NOT NULL AND f.app_name IS NOT DISTINCT FROM c.app_name
   AND f.platform IS NOT DISTINCT FROM c.platform) AS total_processed
FROM cleaned c GROUP BY app_name, platform""", _FLAGGED))
def q_batch_counters(spark, sf):
    from chorus.operators.reports import batch_counters
    return batch_counters(cleaned(spark, sf), flagged(spark, sf, {}))


@query("landed_briefs", _API_SQL + """
SELECT app_name, count(*) AS count, string_agg('- [' || pos || '] ★' || rating || ': ' ||
  CASE WHEN length(review_text) > 600 THEN substr(review_text, 1, 597) || '...' ELSE review_text END, chr(10) ORDER BY pos)
  AS bullets, 'review_text' AS text_key
FROM (SELECT *, row_number() OVER (PARTITION BY app_name ORDER BY md5('42' || review_id), ord) AS pos FROM firsts)
WHERE pos <= 10 GROUP BY app_name""")
def q_landed_briefs(spark, sf):
    """Landed responses to rows to a seeded sample to the lines of a brief, per app."""
    from chorus.plans.brief import app_briefs
    return app_briefs(api_responses(spark, sf), sample=10)


# ------------------------------------------------------------------ large keyword lists (3.7, 4.6, 10.19), unknown keys (10.26)
def _lexicon_words(words: str) -> str:
    """SQL: the words of a list column and its pairs of neighbours."""
    return f"""list_distinct(list_concat({words}, list_transform(range(1, len({words})),
        lambda i: {words}[i] || ' ' || {words}[i + 1])))"""


@query("lexicon_hits", f"""
WITH lexicon AS (SELECT DISTINCT unnest({_lexicon_words("w")}) AS keyword FROM (
    SELECT regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark)),
words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))
    AS keyword FROM words)
SELECT keyword, count(DISTINCT doc_id) AS n_docs, count(*) AS hits FROM grams JOIN lexicon USING (keyword) GROUP BY keyword""")
def q_lexicon_hits(spark, sf):
    """Documents and occurrences of every word and pair of neighbouring words of the benchmark items."""
    from chorus.operators.keywords import keyword_hits
    from chorus.sources.testdata import read_table

    def words(name):
        return F.array_join(T.tokens("text"), " ")

    items = read_table(spark, sf, "benchmark").select(T.tokens("text").alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(
        " ", F.element_at("w", i), F.element_at("w", i + 1)))
    lexicon = items.select(F.explode(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>"))))
                           .alias("keyword"))
    docs = read_table(spark, sf, "documents").select("doc_id", words("text").alias("words"))
    return keyword_hits(docs, lexicon, "doc_id", "words").groupBy("keyword").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.sum("hits").alias("hits"))


@query("flatten_json", """
SELECT event_id, event_type || '.' || k AS path, json_extract_string(props, k) AS value
FROM (SELECT event_id, event_type, props, unnest(json_keys(props)) AS k FROM events)
UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'deep.at.least', 'x' || event_id FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'deep.list', '[1,2]' FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'none', NULL FROM events WHERE event_id % 5 = 1""")
def q_flatten_json(spark, sf):
    """Objects with unequal key sets, made of the events' properties, as rows of dotted paths."""
    from chorus.sources.testdata import read_table
    from chorus.sources.variant import flatten_json
    deep = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"deep":{"at":{"least":"x'), F.col("event_id"),
                                                       F.lit('"},"list":[1,2]}')))
    none = F.when(F.col("event_id") % 5 == 1, F.lit(',"none":null'))
    whole = F.concat(F.lit('{"'), "event_type", F.lit('":'), "props", F.lit(',"user":'), "user_id",
                     F.coalesce(deep, F.lit("")), F.coalesce(none, F.lit("")), F.lit("}"))
    events = read_table(spark, sf, "events").select("event_id", whole.alias("json"))
    return flatten_json(events, ["event_id"], "json")


# ------------------------------------------------------------------ catalog operators on tables (3.3, 8.1, 3.5), 4.3, 10.25
@query("app_sources_union", """
SELECT s_suppkey AS app_key, lower(n_name) AS source FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION SELECT s_suppkey, lower(s_name) FROM supplier
UNION SELECT s_suppkey, unnest(['help', 'france']) FROM supplier""")
def q_app_sources_union(spark, sf):
    """Suppliers as apps, nations as categories with one source each: sources of the category, own name, general ones."""
    from chorus.sources.forum import relevant_sources
    from chorus.sources.testdata import read_table
    apps = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("app_key"), F.col("s_name").alias("name"),
                                                    F.col("s_nationkey").cast("string").alias("category"))
    sources = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("category"),
                                                     F.lower("n_name").alias("source"))
    return relevant_sources(apps, sources, ["help", "france"])


def _catalog_sql() -> str:
    from chorus import lexicons as LX
    from chorus.sources.catalog import APP_SCHEMA
    at = {f.name: k for k, f in enumerate(APP_SCHEMA.fields)}

    def row(app) -> str:
        texts = [("'" + str(app[at[c]]).replace("'", "''") + "'") if app[at[c]] else "NULL" for c in
                 ("app_key", "package_id", "url")]
        return f"({', '.join(texts)}, {len(app[at['keywords']] or [])})"
    return f"(VALUES {', '.join(map(row, LX.APP_CATALOG))}) AS a(app_key, package_id, url, n_keywords)"


def _app_keys() -> list[str]:
    from chorus import lexicons as LX
    return sorted(a[1] for a in LX.APP_CATALOG)


@query("platform_requests", f"""
WITH asked AS (SELECT event_id, coalesce({_app_keys()!r}[CAST(event_id % {len(_app_keys()) + 1} + 1 AS INT)], 'unknown') AS app_key,
  CASE event_id % 4 WHEN 0 THEN 'android' WHEN 1 THEN 'Reddit' WHEN 2 THEN 'ios' ELSE 'web' END AS platform FROM events)
SELECT event_id, asked.app_key, platform, CASE WHEN a.app_key IS NULL THEN 'app'
  WHEN platform = 'android' THEN CASE WHEN package_id IS NULL THEN 'package_id' END
  WHEN platform = 'Reddit' THEN CASE WHEN n_keywords = 0 THEN 'keywords' END
  WHEN url IS NULL THEN 'url' END AS missing
FROM asked LEFT JOIN {_catalog_sql()} ON a.app_key = asked.app_key""")
def q_platform_requests(spark, sf):
    """Events as requests to collect an app on a platform: what each lacks."""
    from chorus.sources.catalog import registered_fields
    from chorus.sources.testdata import read_table
    keys = F.array(*[F.lit(k) for k in _app_keys()])
    key = F.coalesce(F.get(keys, (F.col("event_id") % (len(_app_keys()) + 1)).cast("int")), F.lit("unknown"))
    platform = F.get(F.array(*map(F.lit, ("android", "Reddit", "ios", "web"))), (F.col("event_id") % 4).cast("int"))
    asked = read_table(spark, sf, "events").select("event_id", key.alias("app_key"), platform.alias("platform"))
    return registered_fields(asked, spark)


@query("sentiment_domain", """
SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'bad_sentiment' END AS reject_reason FROM documents""")
def q_sentiment_domain(spark, sf):
    from chorus.sources.landed import sentiment_reject
    from chorus.sources.testdata import read_table
    label = F.get(F.array(*map(F.lit, ("positive", "great", None, "neutral"))), (F.col("doc_id") % 4).cast("int"))
    return read_table(spark, sf, "documents").select("doc_id", label.alias("sentiment")).select(
        "doc_id", sentiment_reject().alias("reject_reason"))


@query("format_timestamp", f"""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{AS_OF[:10]} {AS_OF[11:19]}'
  ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS shown FROM events""")
def q_format_timestamp(spark, sf):
    from chorus.operators.select import format_timestamp
    from chorus.sources.testdata import read_table
    iso = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("no time"))
    return read_table(spark, sf, "events").select("event_id", iso.alias("t")).select(
        "event_id", format_timestamp("t", AS_OF).alias("shown"))
