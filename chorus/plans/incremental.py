"""Runs that take only newly landed files.

``run_new`` reads a folder of review files as a stream that stops when all is read.  The stream's checkpoint knows the
files that are done; each micro-batch is cleaned, flagged and written by its number, overwriting what a failed attempt at
the same batch left, so a restart neither loses nor doubles a row.  Batches are de-duplicated against the keys of the
earlier ones, which are stored beside the rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.operators.dedup import hash_dedup, with_content_hash, with_quality
from chorus.operators.clean import clean, valid_rows
from chorus.plans.pipeline import Settings
from chorus.streaming.stream import read_review_stream


def stored(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame | None:
    """The rows of all batches under ``path`` (of those before ``batch_id``), or None where there are none."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return rows if batch_id is None else rows.where(F.col("run_batch") < batch_id)


def take_batch(rows: DataFrame, batch_id: int, output: str, s: Settings) -> None:
    """Clean one micro-batch, leave out copies within it and of earlier batches, and write it as ``run_batch=<id>``."""
    spark, keys = rows.sparkSession, [*s.batch, "content_hash"]
    new = with_content_hash(valid_rows(clean(rows, s.min_length, s.max_length, s.decode, s.caps_on_original, s.as_of)))
    new = with_quality(hash_dedup(new, s.batch), s.as_of)
    before = stored(spark, output, batch_id)
    if before is not None:
        on = [new[k].eqNullSafe(before[k]) for k in keys]
        new = new.join(before, on, "left_anti")
    new.write.mode("overwrite").parquet(f"{output}/run_batch={batch_id}")


def run_new(spark: SparkSession, landed: str, schema: T.StructType, output: str, checkpoint: str, s: Settings | None = None,
            fmt: str = "parquet", files_per_batch: int | None = None) -> int:
    """Process the files landed since the last run with this ``checkpoint``; the number of micro-batches taken.

    Rows need an ``ord`` that is unique over all files.  Within a batch the first row of a key stays, between batches the
    earlier batch's.  Near-duplicates and best rows per user compare rows of all batches: run ``process`` over the output.
    """
    s = s or Settings()
    taken = []

    def each(rows: DataFrame, batch_id: int) -> None:
        take_batch(rows, batch_id, output, s)
        taken.append(batch_id)

    stream = read_review_stream(spark, landed, schema, fmt, files_per_batch)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(taken)
