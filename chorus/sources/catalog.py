"""App catalog and category -> source mapping as small DataFrames (1.16, 3.2, 3.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus import lexicons as LX

APP_SCHEMA = T.StructType([
    T.StructField("app_group", T.StringType()), T.StructField("app_key", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("package_id", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("platforms", T.ArrayType(T.StringType())), T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("competitors", T.ArrayType(T.StringType())),
])


def apps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LX.APP_CATALOG, APP_SCHEMA)


def category_sources(spark: SparkSession) -> DataFrame:
    rows = [(cat, src) for cat, srcs in LX.CATEGORY_SOURCES.items() for src in srcs]
    return spark.createDataFrame(rows, "category string, source string")


def app_config(spark: SparkSession, app_key: str) -> DataFrame:
    """Lookup by app key (empty frame on a miss: the app is skipped)."""
    return apps(spark).where(F.col("app_key") == app_key)


def apps_by_group(spark: SparkSession, group: str) -> DataFrame:
    return apps(spark).where(F.col("app_group") == group)


def attach_app_config(reviews: DataFrame, spark: SparkSession, key: str = "app_key") -> DataFrame:
    """Inner join to the (fixed-size) catalog, broadcast: rows of unknown apps drop out."""
    return reviews.join(F.broadcast(apps(spark)), key, "inner")


def registered_fields(requested: DataFrame, spark: SparkSession) -> DataFrame:
    """Requested (app_key, platform) pairs whose app has what the platform's collector needs.

    The store needs a package id, the forum keywords, other platforms a page address; ``missing`` names the
    absent field, NULL when the pair can be collected.  Unknown apps miss the app itself.
    """
    a = apps(spark).select("app_key", "package_id", "url", "keywords", F.lit(True).alias("known"))
    j = requested.join(F.broadcast(a), "app_key", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    platform = F.lower("platform")
    store, forum = platform.isin("android", "playstore"), platform == "reddit"
    missing = (F.when(F.col("known").isNull(), "app").when(store & empty("package_id"), "package_id")
               .when(forum & (F.coalesce(F.size("keywords"), F.lit(0)) <= 0), "keywords")
               .when(~store & ~forum & empty("url"), "url"))
    return j.select(*requested.columns, missing.alias("missing"))


def requested_platforms(requested: DataFrame, spark: SparkSession) -> DataFrame:
    """Semi-join: requested (app_key, platform) pairs that the catalog registers."""
    reg = apps(spark).select("app_key", F.explode_outer("platforms").alias("platform"))
    return requested.join(F.broadcast(reg), ["app_key", "platform"], "left_semi")
