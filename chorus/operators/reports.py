"""Report aggregates over the flagged pipeline output.

Input is the frame returned by ``plans.pipeline.process``: every row that
passed cleaning, with ``stage``, ``is_spam``, ``is_duplicate``,
``processed_at`` (survivors) and the classification columns.  Totals count
all of those rows; distributions and averages read processed rows, as the
original's batch statistics do.  All aggregates are grouped aggregations
(partial/final, map-side combined); histograms are long-form rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus import lexicons as LX
from chorus.functions.normalize import safe_rate
from chorus.functions.text import truncate_ellipsis
from chorus.operators.dedup import BATCH

def processed():
    """Rows that survived every step (``processed_at`` set)."""
    return F.col("processed_at").isNotNull()


def _count_if(cond):
    return F.count(F.when(cond, F.lit(1)))


def _avg_or_zero(value, cond):
    return F.coalesce(F.avg(F.when(cond, value)), F.lit(0.0))


def batch_stats(df: DataFrame, batch: Sequence[str] = BATCH) -> DataFrame:
    """Per batch: totals, processed / high-quality / spam / duplicate counts, averages."""
    rated = processed() & F.col("rating").isNotNull() & (F.col("rating") != 0)
    return df.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        _count_if(processed()).alias("processed_reviews"),
        _count_if(F.col("is_high_quality")).alias("high_quality_reviews"),
        _count_if(F.col("is_spam")).alias("spam_reviews"),
        _count_if(F.col("is_duplicate")).alias("duplicate_reviews"),
        _avg_or_zero(F.col("rating").cast("double"), rated).alias("average_rating"),
        _avg_or_zero(F.col("sentiment_score"), processed()).alias("average_sentiment_score"),
    )


def histogram(df: DataFrame, value, name: str, batch: Sequence[str] = BATCH, where=None) -> DataFrame:
    """Long-form histogram ``(batch..., name, count)`` over rows matching ``where`` (processed rows by default)."""
    return (df.where(processed() if where is None else where).groupBy(*batch, value.alias(name)).agg(F.count(F.lit(1)).alias("count")))


def category_hist(df, batch=BATCH):
    return histogram(df, F.coalesce(F.col("primary_category"), F.lit("unclassified")), "category", batch)


def sentiment_hist(df, batch=BATCH):
    return histogram(df, F.coalesce(F.col("sentiment"), F.lit("neutral")), "sentiment", batch)


def rating_hist(df, batch=BATCH):
    rated = processed() & F.col("rating").isNotNull() & (F.col("rating") != 0)
    return histogram(df, F.col("rating"), "rating", batch, rated)


def histogram_map(long: DataFrame, key: str, batch: Sequence[str] = BATCH) -> DataFrame:
    """Long-form histogram -> one ``map<key, count>`` per batch (bounded: one entry per distinct key)."""
    return long.groupBy(*batch).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), "count")))).alias(
            f"{key}_distribution"))


def overall_stats(df: DataFrame) -> DataFrame:
    rated = processed() & F.col("rating").isNotNull() & (F.col("rating") != 0)
    out = df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        _count_if(F.col("is_high_quality")).alias("total_high_quality_reviews"),
        F.countDistinct("app_name").alias("total_apps"),
        F.countDistinct("platform").alias("total_platforms"),
        _avg_or_zero(F.col("rating").cast("double"), rated).alias("average_rating"),
        _avg_or_zero(F.col("sentiment_score"), processed()).alias("average_sentiment_score"),
    )
    return out.withColumn("quality_rate", safe_rate("total_high_quality_reviews", "total_reviews"))


def distribution(df: DataFrame, value) -> DataFrame:
    """One row: counts per value as JSON, names sorted (a label set is small; it is counted before it is gathered)."""
    counts = df.groupBy(value.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.agg(F.collect_list(F.struct("name", "n")).alias("l"))
    return pairs.select(F.to_json(F.map_from_entries(F.array_sort("l"))).alias("distribution"))


def classification_summary(df: DataFrame, threshold: float = LX.CONFIDENCE_THRESHOLD) -> DataFrame:
    p = df.where(processed())
    cat = F.coalesce(F.col("primary_category"), F.lit("unclassified"))
    out = p.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.coalesce(F.avg("classification_confidence"), F.lit(0.0)).alias("average_confidence"),
        _count_if(F.col("classification_confidence") >= threshold).alias("high_confidence_count"),
        _count_if(cat == "unclassified").alias("unclassified_count"),
    )
    out = out.withColumn("classification_rate",
                         F.lit(1.0) - safe_rate("unclassified_count", "total_reviews"))
    out = out.withColumns({"category_distribution": distribution(p, cat).scalar(), "sentiment_distribution":
                           distribution(p, F.coalesce(F.col("sentiment"), F.lit("neutral"))).scalar()})
    return out.where(F.col("total_reviews") > 0)


def category_insights(df: DataFrame) -> DataFrame:
    """Per category (processed rows): count, sentiment mix, average rating (missing = 0), average sentiment."""
    p = df.where(processed() & F.col("primary_category").isNotNull())
    s = F.coalesce(F.col("sentiment"), F.lit("neutral"))
    return p.groupBy(F.col("primary_category").alias("category")).agg(
        F.count(F.lit(1)).alias("review_count"),
        _count_if(s == "positive").alias("positive_count"),
        _count_if(s == "negative").alias("negative_count"),
        _count_if(s == "neutral").alias("neutral_count"),
        F.avg(F.coalesce(F.col("rating"), F.lit(0)).cast("double")).alias("average_rating"),
        F.avg(F.coalesce(F.col("sentiment_score"), F.lit(0.0))).alias("average_sentiment_score"),
    )


def category_keywords_topk(df: DataFrame, k: int = 10) -> DataFrame:
    """Most common keywords per category; ties by first appearance, then keyword."""
    p = df.where(processed() & F.col("primary_category").isNotNull())
    kw = (p.select(F.col("primary_category").alias("category"), "ord", F.explode("keywords_found").alias("keyword"))
          .groupBy("category", "keyword").agg(F.count(F.lit(1)).alias("count"), F.min("ord").alias("first_ord")))
    w = Window.partitionBy("category").orderBy(F.desc("count"), "first_ord", "keyword")
    return (kw.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("category", "rank", "keyword", "count"))


def category_samples(df: DataFrame, n: int = 3, cut: int = LX.INSIGHT_SAMPLE_CUT) -> DataFrame:
    """First ``n`` processed rows per category (by ``ord``), content cut at ``cut`` + '...'.

    ``row_number() <= n`` becomes a per-task group limit before the shuffle,
    so a category holding most rows still ships only ``n`` rows per task.
    """
    p = df.where(processed() & F.col("primary_category").isNotNull())
    w = Window.partitionBy("primary_category").orderBy("ord")
    return (p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(F.col("primary_category").alias("category"), "rank", "ord",
                    truncate_ellipsis(F.coalesce(F.col("content"), F.lit("")), cut).alias("content"),
                    "rating", "sentiment"))


def category_analysis(df: DataFrame) -> DataFrame:
    """Per category other than unclassified: count, average sentiment, average rating of rated rows."""
    p = df.where(processed() & F.col("primary_category").isNotNull() & (F.col("primary_category") != "unclassified"))
    rated = F.col("rating").isNotNull() & (F.col("rating") != 0)
    return p.groupBy(F.col("primary_category").alias("category")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(F.coalesce(F.col("sentiment_score"), F.lit(0.0))).alias("average_sentiment"),
        _avg_or_zero(F.col("rating").cast("double"), rated).alias("average_rating"),
    )


def sentiment_by_grouping_sets(df: DataFrame) -> DataFrame:
    """Average sentiment by platform and by app in one pass (GROUPING SETS)."""
    p = df.where(processed())
    g = p.groupingSets([["platform"], ["app_name"]], "platform", "app_name").agg(
        F.avg(F.coalesce(F.col("sentiment_score"), F.lit(0.0))).alias("average_sentiment"),
        F.count(F.lit(1)).alias("reviews"),
        F.grouping_id().alias("gid"))
    return g.select(F.when(F.col("gid") == 1, F.lit("platform")).otherwise(F.lit("app")).alias("dimension"),
                    F.coalesce(F.when(F.col("gid") == 1, F.col("platform")), F.col("app_name")).alias("key"),
                    "average_sentiment", "reviews")


def quality_metrics(df: DataFrame) -> DataFrame:
    out = df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        _count_if(F.col("is_spam")).alias("spam_count"),
        _count_if(F.col("is_duplicate")).alias("duplicate_count"),
        _count_if(F.col("is_high_quality")).alias("high_quality_count"),
    )
    return out.withColumns({
        "spam_rate": safe_rate("spam_count", "total_reviews"),
        "duplicate_rate": safe_rate("duplicate_count", "total_reviews"),
        "quality_rate": safe_rate("high_quality_count", "total_reviews"),
    })


def insights(df: DataFrame, batch: Sequence[str] = BATCH) -> DataFrame:
    """Highest-rated app (last batch of an app wins) and most discussed category.

    Batches are ordered by their first ``ord``; ties go to the earlier one.
    Returns rows ``(kind, subject, value, text)``.
    """
    stats = batch_stats(df, batch).join(
        df.groupBy(*batch).agg(F.min("ord").alias("batch_ord")), list(batch))
    per_app = (stats.where(F.col("average_rating") > 0).groupBy("app_name")
               .agg(F.max_by("average_rating", "batch_ord").alias("avg"), F.min("batch_ord").alias("first_ord")))
    best = per_app.agg(F.max(F.struct("avg", (-F.col("first_ord")).alias("neg"), "app_name")).alias("b"))
    best = best.where(F.col("b").isNotNull()).select(
        F.lit("highest_rated_app").alias("kind"), F.col("b.app_name").alias("subject"),
        F.col("b.avg").alias("value"))
    cats = (df.where(processed() & F.col("primary_category").isNotNull() & (F.col("primary_category") != "unclassified"))
            .groupBy("primary_category").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")))
    top = cats.agg(F.max(F.struct("n", (-F.col("first_ord")).alias("neg"), "primary_category")).alias("b"))
    top = top.where(F.col("b").isNotNull()).select(
        F.lit("most_discussed_category").alias("kind"), F.col("b.primary_category").alias("subject"),
        F.col("b.n").cast("double").alias("value"))
    return best.unionByName(top)


def insight_text(kind: str, subject: str, value: float) -> str:
    """The sentence the original prints for an insight row (driver-side, one row)."""
    if kind == "highest_rated_app":
        return f"Highest rated app: {subject} ({value:.1f}/5)"
    return f"Most discussed category: {subject} ({int(value)} reviews)"


def funnel(cleaned: DataFrame, flagged: DataFrame, batch: Sequence[str] = BATCH) -> DataFrame:
    """original -> cleaned -> de-duplicated -> classified -> final, per batch, from one flagged plan."""
    orig = cleaned.groupBy(*batch).agg(F.count(F.lit(1)).alias("original"),
                                       _count_if(F.col("drop_reason").isNull()).alias("cleaned"))
    kept = F.col("stage") == "kept"
    after = flagged.groupBy(*batch).agg(
        _count_if(F.col("stage") != "hash_duplicate").alias("after_hash"),
        _count_if(~F.col("stage").isin("hash_duplicate", "near_duplicate")).alias("after_similarity"),
        _count_if(~F.col("stage").isin("hash_duplicate", "near_duplicate", "spam")).alias("after_spam"),
        _count_if(kept).alias("deduplicated"),
        _count_if(kept & F.col("primary_category").isNotNull()).alias("classified"),
        _count_if(kept).alias("final"))
    out = orig.join(after, list(batch), "left").fillna(0)
    return out.withColumn("processing_rate", safe_rate("final", "original"))


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    """original, cleaned, removed, removal rate, average length reduction (by review_id).

    One aggregation over ``cleaned`` left-joined (equi-join on review_id) to
    the original length of each id -- the last original row wins, as in the
    original's dict build.
    """
    orig_last = cleaned.groupBy("review_id").agg(
        F.max_by(F.length(F.coalesce(F.col("raw_content"), F.lit(""))), F.col("ord")).alias("orig_len"))
    j = cleaned.select("review_id", "drop_reason", "cleaned_length").join(orig_last, "review_id", "left")
    ok = F.col("drop_reason").isNull()
    red = F.when(ok & (F.col("orig_len") > 0),
                 (F.col("orig_len") - F.col("cleaned_length")) / F.col("orig_len"))
    out = j.agg(F.count(F.lit(1)).alias("original_count"), _count_if(ok).alias("cleaned_count"),
                F.coalesce(F.avg(red), F.lit(0.0)).alias("average_length_reduction"))
    return out.select("original_count", "cleaned_count",
                      (F.col("original_count") - F.col("cleaned_count")).alias("removed_count"),
                      safe_rate(F.col("original_count") - F.col("cleaned_count"), "original_count").alias("removal_rate"),
                      "average_length_reduction")


def length_reduction(cleaned: DataFrame) -> DataFrame:
    """(ord, review_id, orig_len, cleaned_length, reduction) of the valid rows: each is joined with the original length of
    its review_id, of which the last original row counts."""
    orig = cleaned.groupBy("review_id").agg(
        F.max_by(F.length(F.coalesce(F.col("raw_content"), F.lit(""))), F.col("ord")).alias("orig_len"))
    valid = cleaned.where(F.col("drop_reason").isNull()).select("ord", "review_id", "cleaned_length")
    share = F.when(F.col("orig_len") > 0, (F.col("orig_len") - F.col("cleaned_length")) / F.col("orig_len"))
    return valid.join(orig, "review_id").select("ord", "review_id", "orig_len", "cleaned_length", share.alias("reduction"))


def batch_counters(cleaned: DataFrame, flagged: DataFrame, batch: Sequence[str] = BATCH) -> DataFrame:
    """Per batch: rows collected, and rows that came through every step."""
    collected = cleaned.groupBy(*batch).agg(F.count(F.lit(1)).alias("total_scraped"))
    done = flagged.groupBy(*batch).agg(_count_if(processed()).alias("total_processed"))
    on = [F.col(f"c.{b}").eqNullSafe(F.col(f"d.{b}")) for b in batch]
    return collected.alias("c").join(done.alias("d"), on, "left").select(
        *[F.col(f"c.{b}") for b in batch], "total_scraped", F.coalesce("total_processed", F.lit(0)).alias("total_processed"))


def _gathered(rows: DataFrame, value, order, name: str) -> DataFrame:
    """One row: the values of a small frame (one row per batch, category or the like) as a list, in order."""
    pairs = rows.agg(F.collect_list(F.struct(F.struct(*order).alias("o"), value.alias("v"))).alias("l"))
    # By the order alone: values may hold maps, which have none.
    by_order = F.array_sort("l", lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0))
    return pairs.select(F.transform(by_order, lambda x: x["v"]).alias(name))


def summary_document(flagged: DataFrame, generated_at: str, batch: Sequence[str] = BATCH,
                     scraped_at: str | None = None) -> DataFrame:
    """One row, one JSON ``document``: report_metadata, overall_stats, and batch_summaries with their distributions.

    The document has an entry per batch and label, as a report does; everything else is counted before it is gathered.
    """
    stats = batch_stats(flagged, batch).join(flagged.groupBy(*batch).agg(F.min("ord").alias("_first")), list(batch))
    for hist, key in ((category_hist, "category"), (sentiment_hist, "sentiment"), (rating_hist, "rating")):
        stats = stats.join(histogram_map(hist(flagged, batch), key, batch), list(batch), "left")
        name = f"{key}_distribution"
        stats = stats.withColumn(name, F.coalesce(name, F.create_map().cast("map<string,bigint>")))
    entry = F.struct(*batch, "total_reviews", "processed_reviews", "high_quality_reviews", "spam_reviews", "duplicate_reviews",
                     "category_distribution", "sentiment_distribution", "rating_distribution", "average_rating",
                     "average_sentiment_score", F.lit(scraped_at).cast("string").alias("scraped_at"),
                     F.create_map(F.lit("spam"), F.col("spam_reviews"), F.lit("duplicates"), F.col("duplicate_reviews"))
                     .alias("processing_stats"))
    listed = _gathered(stats, entry, ["_first", *batch], "batch_summaries")
    overall = overall_stats(flagged).select(F.struct("*")).scalar().alias("overall_stats")
    meta = F.struct(F.lit(generated_at).alias("generated_at"), F.size("batch_summaries").alias("total_batches"),
                    F.lit("summary").alias("report_type"))
    return listed.select(F.to_json(F.struct(meta.alias("report_metadata"), overall, "batch_summaries")).alias("document"))


def analysis_document(flagged: DataFrame, generated_at: str, batch: Sequence[str] = BATCH) -> DataFrame:
    """One row, one JSON ``document``: report_metadata, insights, category_analysis, sentiment_trends, quality_metrics."""
    shown = F.when(F.col("kind") == "highest_rated_app",
                   F.concat(F.lit("Highest rated app: "), F.col("subject"), F.lit(" ("),
                            F.format_string("%.1f", F.bround("value", 1)), F.lit("/5)"))).otherwise(
        F.concat(F.lit("Most discussed category: "), F.col("subject"), F.lit(" ("),
                 F.col("value").cast("long").cast("string"), F.lit(" reviews)")))
    texts = _gathered(insights(flagged, batch), shown, ["kind"], "insights")

    def mapped(rows: DataFrame, key: str, value, name: str):
        """A small frame as a map, as a scalar subquery."""
        entries = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value")))).alias("l"))
        return entries.select(F.map_from_entries("l")).scalar().alias(name)

    measures = F.struct("count", "average_sentiment", "average_rating")
    categories = mapped(category_analysis(flagged), "category", measures, "category_analysis")
    trends = sentiment_by_grouping_sets(flagged).where(F.col("key").isNotNull())
    by_platform = mapped(trends.where("dimension = 'platform'"), "key", F.col("average_sentiment"), "by_platform")
    by_app = mapped(trends.where("dimension = 'app'"), "key", F.col("average_sentiment"), "by_app")
    metrics = quality_metrics(flagged).select(F.struct("*")).scalar().alias("quality_metrics")
    meta = F.struct(F.lit(generated_at).alias("generated_at"), F.lit("analysis").alias("report_type"))
    return texts.select(F.to_json(F.struct(meta.alias("report_metadata"), "insights", categories, F.struct(by_platform, by_app)
                                           .alias("sentiment_trends"), metrics)).alias("document"))


def dedup_stats(flagged: DataFrame, threshold: float = LX.SIMILARITY_THRESHOLD) -> DataFrame:
    out = flagged.agg(F.count(F.lit(1)).alias("original_count"),
                      _count_if(F.col("stage") == "kept").alias("final_count"))
    return out.select("original_count", "final_count",
                      (F.col("original_count") - F.col("final_count")).alias("removed_count"),
                      safe_rate(F.col("original_count") - F.col("final_count"), "original_count").alias("removal_rate"),
                      F.lit(float(threshold)).alias("similarity_threshold"))


def theme_brief(df: DataFrame, quotes: int = 3) -> DataFrame:
    """Share of each category and sentiment, plus the shortest distinct verbatim texts.

    Rows ``(section, key, share, text)``; shares are fractions of processed rows.
    """
    p = df.where(processed())
    cat = (p.groupBy(F.coalesce("primary_category", F.lit("unclassified")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
           .withColumn("section", F.lit("category")))
    sen = (p.groupBy(F.coalesce("sentiment", F.lit("neutral")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
           .withColumn("section", F.lit("sentiment")))
    # a handful of aggregated rows: the section-wide window is over tiny input
    total = F.sum("n").over(Window.partitionBy("section"))
    shares = cat.unionByName(sen).select("section", "key", (F.col("n") / total).alias("share"),
                                         F.lit(None).cast("string").alias("text"))
    # Equal texts meet by a hash, without their texts; the few chosen rows then fetch theirs.
    first = p.groupBy(F.sha2("content", 256).alias("_h"), F.length("content").alias("_n")).agg(F.min("ord").alias("ord"))
    # top-k: per-task partial top-k, then a merge of at most k rows per task
    chosen = first.orderBy("_n", "ord").limit(quotes).select("ord")
    shortest = p.select("ord", "content").join(F.broadcast(chosen), "ord", "left_semi")
    q = (shortest.withColumn("rank", F.row_number().over(Window.orderBy(F.length("content"), "ord")))
         .select(F.lit("quote").alias("section"), F.col("rank").cast("string").alias("key"),
                 F.lit(None).cast("double").alias("share"), F.col("content").alias("text")))
    return shares.unionByName(q)
