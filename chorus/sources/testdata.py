"""Adapters from the driver's tables to the review schema.

``documents`` plays the review table: ``lang`` is the app, ``source`` the
forum.  Attributes the corpus lacks (platform, rating, user, helpfulness,
date) are derived deterministically from ``doc_id`` so runs are repeatable;
nothing is filtered.  ``conversations`` plays a forum thread (turn 0 = post,
later turns = comments).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Session setting: number of partitions that the review adapter deals rows to.  Unset, the scan's own splits are
#: used; a local run over one small file sets it to use all cores.
PARTITIONS = "spark.chorus.inputPartitions"


def reviews_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> raw review rows with an ingest ordinal ``ord``."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    i = F.col("doc_id")
    out = d.select(
        i.alias("ord"),
        F.concat(F.lit("doc_"), i.cast("string")).alias("review_id"),
        F.when(i % 3 == 0, "reddit").when(i % 3 == 1, "playstore").otherwise("appstore").alias("platform"),
        F.col("lang").alias("app_name"),
        F.substring("text", 1, 30).alias("title"),
        F.col("text").alias("content"),
        F.when(i % 7 == 6, F.lit(None)).otherwise((F.lit(1) + i % 5).cast("int")).cast("int").alias("rating"),
        F.when(i % 11 == 10, F.lit(None)).otherwise(F.concat(F.lit("u"), (i % 97).cast("string"))).alias("user_id"),
        (i % 3 == 1).alias("verified"),
        (i % 23).cast("int").alias("helpful_count"),
        (i % 4).cast("int").alias("reply_count"),
        F.date_add(F.lit("2023-01-01").cast("date"), (i % 730).cast("int")).cast("string").alias("review_date"),
    )
    n = spark.conf.get(PARTITIONS, None)
    return out.repartition(int(n), "ord") if n else out


def forum_threads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """conversations -> (posts, comments) in the landed forum shape."""
    c = read_table(spark, sf_dir, "conversations")
    posts = c.where(F.col("turn") == 0).select(
        F.col("conv_id").cast("string").alias("id"),
        F.concat(F.lit("user"), (F.col("conv_id") % 50).cast("string")).alias("author"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("selftext"),
        (F.col("conv_id") % 40).alias("score"),
        F.lit(0).alias("num_comments"),
        (F.lit(1704067200) + F.col("conv_id") * 3600).alias("created_utc"),
        F.concat(F.lit("/r/src/comments/"), F.col("conv_id").cast("string")).alias("permalink"),
        F.lit("src").alias("subreddit"),
        (F.col("conv_id") * F.lit(1 << 20)).alias("ord"),
    )
    comments = c.where(F.col("turn") > 0).select(
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("parent_id"),
        F.when(F.col("role") == "system", F.lit(None)).otherwise(F.col("role")).alias("author"),
        F.col("text").alias("body"),
        (F.col("turn") * 2).alias("score"),
        (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_utc"),
        F.lit("src").alias("subreddit"),
        F.col("turn"),
        (F.col("conv_id") * F.lit(1 << 20) + F.col("turn")).alias("ord"),
    )
    return posts, comments
