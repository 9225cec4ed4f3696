"""Landed forum posts and comments -> review rows (posts, comments, parent join)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus import lexicons as LX
from chorus.functions.normalize import epoch_to_iso, sentiment_to_rating
from chorus.functions.scores import simple_sentiment
from chorus.functions.text import contains_any


def relevant_posts(posts: DataFrame, keywords) -> DataFrame:
    """Posts where any keyword is a case-insensitive substring of ``title + ' ' + selftext``."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))
    return posts.where(contains_any(text, keywords))


def relevant_comments(comments: DataFrame, keywords) -> DataFrame:
    """Comments containing a keyword and longer than 20 characters."""
    body = F.coalesce(F.col("body"), F.lit(""))
    return comments.where(contains_any(body, keywords) & (F.length(body) > 20))


def normalize_posts(posts: DataFrame, app_name: str, keywords, positive=None, negative=None) -> DataFrame:
    """Relevant posts in the review schema; rating from the simple sentiment."""
    p = relevant_posts(posts, keywords)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("selftext", F.lit("")))
    p = p.withColumn("sentiment_score", simple_sentiment(text, positive or LX.SIMPLE_POSITIVE,
                                                         negative or LX.SIMPLE_NEGATIVE))
    author = F.coalesce(F.col("author"), F.lit("deleted"))
    return p.select(
        *[F.col("ord")] * ("ord" in posts.columns),
        F.concat(F.lit("reddit_post_"), F.col("id")).alias("review_id"),
        F.lit("reddit").alias("platform"), F.lit(app_name).alias("app_name"),
        author.alias("user_id"), author.alias("username"),
        "title", F.col("selftext").alias("content"), "sentiment_score",
        sentiment_to_rating(F.col("sentiment_score")).alias("rating"),
        epoch_to_iso(F.col("created_utc")).alias("review_date"),
        F.col("score").cast("long").alias("helpful_count"),
        F.col("num_comments").cast("long").alias("reply_count"),
        F.concat(F.lit("https://reddit.com"), F.col("permalink")).alias("source_url"),
        F.to_json(F.struct(F.col("subreddit"), F.col("sentiment_score"), F.lit("submission").alias("post_type")))
         .alias("raw_data"))


def comments_with_parent(comments: DataFrame, posts: DataFrame, cut: int = LX.COMMENT_TITLE_CUT) -> DataFrame:
    """Comment rows titled from their parent post (equi-join on the parent id)."""
    parent = posts.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    j = comments.join(parent, "parent_id")
    return j.select(
        F.concat(F.lit("reddit_comment_"), F.col("id")).alias("review_id"),
        F.col("parent_id").alias("parent_post_id"),
        F.concat(F.lit("Comment on: "), F.substring(F.coalesce("parent_title", F.lit("")), 1, cut), F.lit("..."))
         .alias("title"),
        F.coalesce(F.col("author"), F.lit("deleted")).alias("user_id"),
        F.col("body").alias("content"),
        F.col("score").cast("long").alias("helpful_count"))


def normalize_comments(comments: DataFrame, posts: DataFrame, app_name: str, keywords, per_post: int = 5, positive=None,
                       negative=None, order: str = "ord", cut: int = LX.COMMENT_TITLE_CUT) -> DataFrame:
    """The relevant ones of each post's first ``per_post`` comments, in the review schema.

    ``row_number() <= per_post`` is a group limit in each task before the shuffle, so a hot thread ships a few rows
    per task; the parent's title is joined to what is left.
    """
    first = (comments.withColumn("_rn", F.row_number().over(Window.partitionBy("parent_id").orderBy(order)))
             .where(F.col("_rn") <= per_post).drop("_rn"))
    parent = posts.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    c = relevant_comments(first, keywords).join(parent, "parent_id")
    c = c.withColumn("sentiment_score", simple_sentiment("body", positive or LX.SIMPLE_POSITIVE,
                                                         negative or LX.SIMPLE_NEGATIVE))
    author = F.coalesce(F.col("author"), F.lit("deleted"))
    have = lambda name, kind: F.col(name) if name in comments.columns else F.lit(None).cast(kind)
    return c.select(
        F.col(order).alias("ord"), F.concat(F.lit("reddit_comment_"), F.col("id")).alias("review_id"),
        F.lit("reddit").alias("platform"), F.lit(app_name).alias("app_name"),
        author.alias("user_id"), author.alias("username"),
        F.concat(F.lit("Comment on: "), F.substring(F.coalesce("parent_title", F.lit("")), 1, cut), F.lit("..."))
         .alias("title"),
        F.col("body").alias("content"), "sentiment_score",
        sentiment_to_rating(F.col("sentiment_score")).alias("rating"),
        epoch_to_iso(F.col("created_utc")).alias("review_date"),
        F.col("score").cast("long").alias("helpful_count"),
        F.coalesce(have("num_replies", "long"), F.lit(0)).cast("long").alias("reply_count"),
        F.concat(F.lit("https://reddit.com"), have("permalink", "string")).alias("source_url"),
        F.to_json(F.struct(have("subreddit", "string").alias("subreddit"), F.col("parent_id").alias("parent_post_id"),
                           F.col("sentiment_score"), F.lit("comment").alias("post_type"))).alias("raw_data"))


def relevant_sources(apps: DataFrame, category_sources: DataFrame, general=None) -> DataFrame:
    """Per app: category sources + its own name + the general sources, distinct (3.3 / 8.1)."""
    general = general or LX.GENERAL_SOURCES
    by_cat = apps.join(category_sources, "category", "left").select("app_key", "source")
    own = apps.select("app_key", F.lower("name").alias("source"))
    gen = apps.select("app_key", F.explode(F.array(*[F.lit(g) for g in general])).alias("source"))
    return by_cat.where(F.col("source").isNotNull()).unionByName(own).unionByName(gen).distinct()
