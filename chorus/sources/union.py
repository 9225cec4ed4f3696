"""Review rows of several sources as one input: one ordinal rule, and sources that fail alone."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.sources.landed import batch_rejects, canonical, read_batch_json, reject_reason, sentiment_reject

log = logging.getLogger("chorus.sources")

#: Ordinals of one source are below this; source number times it is added.
SOURCE_WIDTH = 1 << 48
#: Rejected documents of a path that are named in the log; ``batch_rejects`` has all.
LOGGED_REJECTS = 100


def collect(spark: SparkSession, inputs: Iterable[DataFrame | str]) -> list[DataFrame]:
    """Frames as they are, paths as batch JSON documents; a missing path and corrupt documents are logged and skipped."""
    frames = []
    for source in inputs:
        if isinstance(source, DataFrame):
            frames.append(source)
            continue
        try:
            for reject in batch_rejects(spark, source).limit(LOGGED_REJECTS).collect():
                log.warning("skipped %s: %s", reject.file, reject.reason)
            frames.append(read_batch_json(spark, source)[1])
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            log.warning("skipped %s: no such path", source)
    return frames


def union_reviews(frames: Sequence[DataFrame], scraped_at: str | None = None) -> DataFrame:
    """All sources in the review schema with ``ord`` unique across them.

    A source's own ``ord`` (unique within it, 0 to 2**48) keeps its order; one without gets an ordinal by partition and
    row, which is fixed once the result is written.  Rows that the record checks refuse are left out.
    """
    parts = []
    for k, frame in enumerate(frames):
        own = F.col("ord") if "ord" in frame.columns else F.monotonically_increasing_id()
        rows = canonical(frame.withColumn("ord", own.cast("long")), scraped_at=scraped_at)
        parts.append(rows.withColumn("ord", F.col("ord") + F.lit(k * SOURCE_WIDTH)))
    if not parts:
        raise ValueError("no source to read")
    rows = reduce(DataFrame.unionByName, parts)
    return rows.where(reject_reason().isNull() & sentiment_reject().isNull())
