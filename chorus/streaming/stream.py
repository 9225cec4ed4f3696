"""Structured Streaming form of the row-level stages.

The original has no streaming; these are the same column expressions on
``readStream`` (an extension).  Cleaning, validity and classification are
per-row, so they run unchanged; exact de-duplication uses
``dropDuplicatesWithinWatermark`` on the content hash; daily sentiment is a
watermarked tumbling window.  Near-duplicate removal stays a batch job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus import lexicons as LX
from chorus.functions.text import content_hash
from chorus.operators.classify import classify
from chorus.operators.clean import clean, valid_rows


def read_review_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def clean_classify_stream(stream: DataFrame, event_time: str = "review_ts", watermark: str = "1 day",
                          batch: Sequence[str] = ("app_name", "platform"), lexicon=None, positive=None,
                          negative=None, as_of: str | None = None) -> DataFrame:
    """Clean, keep valid rows, drop exact copies within the watermark, classify."""
    c = valid_rows(clean(stream, as_of=as_of))
    c = c.withColumn("content_hash", content_hash("title", "content"))
    if event_time not in c.columns:
        c = c.withColumn(event_time, F.to_timestamp("review_date"))
    deduped = c.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([*batch, "content_hash"])
    return classify(deduped, lexicon, positive, negative, LX.CONFIDENCE_THRESHOLD, as_of)


def daily_sentiment(classified: DataFrame, event_time: str = "review_ts", watermark: str = "1 day") -> DataFrame:
    """Per app and day: review count and average sentiment (append mode after the watermark)."""
    return (classified.withWatermark(event_time, watermark)
            .groupBy("app_name", F.window(event_time, "1 day").alias("day"))
            .agg(F.count(F.lit(1)).alias("reviews"), F.avg("sentiment_score").alias("average_sentiment")))


def best_rows_stream(scored: DataFrame, batch: Sequence[str] = ("app_name", "platform")) -> DataFrame:
    """(batch, user_id, ord, quality_score): the best row per user so far, the first on ties; for update mode.

    Each micro-batch emits the users whose best row has changed, so the last row of a key is the correction that holds;
    the final rows are those of ``user_dedup``.  The state is one number pair a user, kept for good: use the
    RocksDB state store where users are many.
    """
    keys = list(dict.fromkeys([*batch, "user_id"]))
    best = F.max(F.struct(F.col("quality_score").alias("s"), (-F.col("ord")).alias("neg")))
    return scored.groupBy(*keys).agg(best.alias("b")).select(
        *keys, (-F.col("b.neg")).alias("ord"), F.col("b.s").alias("quality_score"))


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
                      mode: str = "append"):
    """Process everything available, then stop (restartable from ``checkpoint``)."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink_path))
    q.awaitTermination()
    return q
