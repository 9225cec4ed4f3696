"""Config tables: app lookup, category -> source union (3.2, 3.3, 8.1) and result overlay (4.16)."""

from chorus import lexicons as LX
from chorus.sources import catalog
from chorus.sources.forum import relevant_sources
from chorus.sources.landed import overlay


def test_relevant_sources_union_distinct(spark):
    apps = catalog.apps(spark).where("app_key = 'day_one'")
    got = {r.source for r in relevant_sources(apps, catalog.category_sources(spark)).collect()}
    expected = set(LX.CATEGORY_SOURCES["journaling"]) | {"day one"} | set(LX.GENERAL_SOURCES)
    assert got == expected


def test_app_lookup_and_platform_semi_join(spark):
    assert catalog.app_config(spark, "missing").count() == 0
    req = spark.createDataFrame([("spotify", "android"), ("spotify", "reddit"), ("day_one", "reddit")],
                                ["app_key", "platform"])
    got = {(r.app_key, r.platform) for r in catalog.requested_platforms(req, spark).collect()}
    assert got == {("spotify", "android"), ("day_one", "reddit")}


def test_overlay_replaces_non_null_and_stamps(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "y", None)], "review_id string, sentiment string, processed_at string")
    upd = spark.createDataFrame([("a", "positive")], ["review_id", "sentiment"])
    got = {r.review_id: r for r in overlay(df, upd, as_of="2025-01-01T00:00:00").collect()}
    assert got["a"].sentiment == "positive" and got["a"].processed_at == "2025-01-01T00:00:00"
    assert got["b"].sentiment == "y" and got["b"].processed_at is None
