"""Exports: partitioned CSV / JSON writers and report rows (all distributed writes)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType

from chorus import lexicons as LX
from chorus.operators.chunks import chunk_numbers
from chorus.operators.dedup import BATCH
from chorus.operators.reports import processed
from chorus.schema import REVIEW_FIELDS, REVIEW_SCHEMA


def py_round(c, digits: int):
    """Half-to-even rounding of ``c * 10**digits`` (the original rounds with Python ``round``)."""
    scale = float(10 ** digits)
    return F.bround(c * scale, 0) / scale


def summary_rows(df: DataFrame, batch: Sequence[str] = BATCH) -> DataFrame:
    """One summary-CSV row per batch: rating rounded to 2, sentiment to 3, sentiment counts."""
    rated = processed() & F.col("rating").isNotNull() & (F.col("rating") != 0)
    s = F.coalesce(F.col("sentiment"), F.lit("neutral"))
    out = df.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count(F.when(F.col("is_high_quality"), 1)).alias("high_quality_reviews"),
        F.coalesce(F.avg(F.when(rated, F.col("rating").cast("double"))), F.lit(0.0)).alias("_ar"),
        F.coalesce(F.avg(F.when(processed(), F.col("sentiment_score"))), F.lit(0.0)).alias("_as"),
        F.count(F.when(processed() & (s == "positive"), 1)).alias("positive_sentiment_count"),
        F.count(F.when(processed() & (s == "negative"), 1)).alias("negative_sentiment_count"),
        F.count(F.when(processed() & (s == "neutral"), 1)).alias("neutral_sentiment_count"))
    return out.select(*batch, "total_reviews", "high_quality_reviews",
                      py_round(F.col("_ar"), 2).alias("average_rating"),
                      py_round(F.col("_as"), 3).alias("average_sentiment_score"),
                      "positive_sentiment_count", "negative_sentiment_count", "neutral_sentiment_count")


def csv_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV cell text: maps/arrays as JSON, NULL as '', booleans as True/False, else the string."""
    cols = []
    types = {f.name: f.dataType for f in df.schema.fields}
    for c in columns or [f for f in REVIEW_FIELDS if f in types]:
        t = types[c]
        if isinstance(t, (ArrayType, MapType)):
            v = F.to_json(F.col(c))
        elif isinstance(t, BooleanType):
            v = F.when(F.col(c), F.lit("True")).when(~F.col(c), F.lit("False"))
        else:
            v = F.col(c).cast("string")
        cols.append(F.coalesce(v, F.lit("")).alias(c))
    return df.select(*cols)


def write_reviews_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ("app_name", "platform"),
                      max_rows_per_file: int = LX.MAX_ROWS_PER_FILE) -> None:
    """Review rows as header CSV, one folder per (app, platform), at most N rows per file."""
    cells = csv_cells(df, [c for c in REVIEW_FIELDS if c in df.columns])
    (cells.write.mode("overwrite").partitionBy(*partition_by).option("header", True)
     .option("maxRecordsPerFile", max_rows_per_file).option("escape", '"').csv(path))


def write_reviews_json(df: DataFrame, path: str, partition_by: Sequence[str] = ("app_name", "platform")) -> None:
    """Review rows as JSON Lines, one folder per (app, platform)."""
    df.select(*[c for c in REVIEW_FIELDS if c in df.columns]).write.mode("overwrite").partitionBy(
        *partition_by).json(path)


def write_batch_json(flagged: DataFrame, path: str, exported_at: str, batch: Sequence[str] = BATCH,
                     rows_per_document: int = LX.MAX_ROWS_PER_FILE) -> None:
    """``{metadata, reviews}`` documents, one per file, that ``read_batch_json`` reads back.

    A batch is cut into documents of at most ``rows_per_document`` reviews (by row number, so no batch is gathered into
    one task); each carries the batch's totals and its own number.
    """
    totals = flagged.groupBy(*batch).agg(
        F.count(F.lit(1)).alias("total_scraped"), F.count(F.when(processed(), 1)).alias("total_processed"),
        F.count(F.when(F.col("is_spam"), 1)).alias("spam"), F.count(F.when(F.col("is_duplicate"), 1)).alias("duplicates"))
    fields = [f for f in REVIEW_SCHEMA.fields]
    record = F.struct(*[(F.col(f.name) if f.name in flagged.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in fields])
    rows = chunk_numbers(flagged, list(batch), rows_per_document).select(*batch, "chunk", "ord", record.alias("r"))
    documents = rows.groupBy(*batch, "chunk").agg(F.collect_list(F.struct("ord", "r")).alias("l"))
    own = totals.select(*[F.col(b).alias(f"_t_{b}") for b in batch], "total_scraped", "total_processed", "spam",
                        "duplicates")
    joined = documents.join(own, [F.col(b).eqNullSafe(F.col(f"_t_{b}")) for b in batch])
    stats = F.create_map(F.lit("document"), F.col("chunk"), F.lit("spam"), F.col("spam"), F.lit("duplicates"),
                         F.col("duplicates"))
    meta = F.struct(*[F.col(b) for b in batch], F.lit(exported_at).alias("scraped_at"), "total_scraped",
                    "total_processed", stats.alias("processing_stats"))
    out = joined.select(meta.alias("metadata"), F.transform(
        # By ordinal alone: records hold maps, which have no order.
        F.array_sort("l", lambda x, y: F.when(x["ord"] < y["ord"], -1).when(x["ord"] > y["ord"], 1).otherwise(0)),
        lambda x: x["r"]).alias("reviews"))
    out.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Small report frames (a few rows) as a single file."""
    w = df.coalesce(1).write.mode("overwrite")
    (w.json(path) if fmt == "json" else w.option("header", True).csv(path))


def write_document(document: DataFrame, path: str) -> None:
    """A one-row frame of JSON text as one file."""
    document.coalesce(1).write.mode("overwrite").text(path)


def export_results(flagged: DataFrame, out_dir: str, formats: Sequence[str] = ("csv", "json", "report"),
                   batch: Sequence[str] = BATCH, exported_at: str = "") -> dict[str, str]:
    """Format dispatch: reviews as CSV/JSON, ``batch`` documents, and the report set (summary, detail, analysis)."""
    from chorus.operators import reports as R
    out = {}
    final = flagged.where(processed())
    if "csv" in formats:
        write_reviews_csv(final, f"{out_dir}/reviews_csv")
        out["csv"] = f"{out_dir}/reviews_csv"
    if "json" in formats:
        write_reviews_json(final, f"{out_dir}/reviews_json")
        out["json"] = f"{out_dir}/reviews_json"
    if "batch" in formats:
        write_batch_json(flagged, f"{out_dir}/batches", exported_at, batch)
        out["batch"] = f"{out_dir}/batches"
    if "report" in formats:
        write_document(R.summary_document(flagged, exported_at, batch), f"{out_dir}/report/summary")
        write_document(R.analysis_document(flagged, exported_at, batch), f"{out_dir}/report/analysis")
        write_reviews_csv(flagged.where(F.col("is_high_quality")), f"{out_dir}/report/high_quality")
        write_report(summary_rows(flagged, batch), f"{out_dir}/report/summary_csv", fmt="csv")
        out["report"] = f"{out_dir}/report"
    return out
