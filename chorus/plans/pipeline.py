"""The processing pipeline as one lazy DataFrame plan.

clean -> exact de-dup -> near de-dup -> spam -> per-user de-dup -> classify,
per batch (``app_name, platform`` by default).  Rows are flagged, never
silently dropped: ``stage`` names the step that removed a row (``kept`` for
survivors) and ``processed_at`` is set on survivors only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus import lexicons as LX
from chorus.operators.classify import classify
from chorus.operators.clean import clean, valid_rows, with_cleaned_content
from chorus.operators.dedup import (BATCH, first_per_key, best_per_key, with_content_hash, with_quality,
                                    with_spam)
from chorus.sources.testdata import reviews_from_documents

AS_OF = "2025-01-01T00:00:00"
STAGES = ["hash_duplicate", "near_duplicate", "spam", "user_duplicate", "kept"]


@dataclass
class Settings:
    batch: Sequence[str] = BATCH
    as_of: str = AS_OF
    min_length: int = LX.MIN_CONTENT_LENGTH
    max_length: int = LX.MAX_CONTENT_LENGTH
    similarity_threshold: float | None = LX.SIMILARITY_THRESHOLD
    confidence_threshold: float = LX.CONFIDENCE_THRESHOLD
    lexicon: dict | None = None
    positive: dict | None = None
    negative: dict | None = None
    caps_on_original: bool = False
    skip_null_user: bool = False
    decode: bool = True


TEST_SETTINGS = dict(lexicon=LX.TEST_TOPIC_LEXICON, positive=LX.TEST_POSITIVE_WEIGHTS,
                     negative=LX.TEST_NEGATIVE_WEIGHTS)


def prepared(cleaned: DataFrame, s: Settings) -> DataFrame:
    """Valid rows with content hash, quality score and review-spam flags."""
    v = valid_rows(cleaned)
    v = with_content_hash(v)
    v = with_quality(v, s.as_of)
    return with_spam(v, s.caps_on_original)


def narrow(v: DataFrame, batch: Sequence[str]) -> DataFrame:
    """What the de-dup steps need of a row: no texts."""
    cols = dict.fromkeys(["ord", *batch, "app_name", "user_id", "content_hash", "quality_score", "spam_hits", "is_spam"])
    return v.select(*cols)


def flag_stages(rows: DataFrame, s: Settings, near_dup_winners: DataFrame | None = None) -> DataFrame:
    """(ord, stage) by the four de-dup steps in order, over narrow rows.

    Each step's winners come from a grouped aggregate; rows are joined with them on the unique ``ord``.
    """
    batch = list(s.batch)
    won = lambda winners, name: winners.select("ord", F.lit(True).alias(name))
    df = rows.join(won(first_per_key(rows, [*batch, "content_hash"]), "_first"), "ord", "left")
    if near_dup_winners is not None:
        df = df.join(won(near_dup_winners, "_lead"), "ord", "left")
    lead = F.col("_lead").isNull() if near_dup_winners is not None else F.lit(False)
    df = df.withColumn("stage", F.when(F.col("_first").isNull(), "hash_duplicate").when(lead, "near_duplicate")
                       .when(F.col("is_spam"), "spam"))
    live = df.where(F.col("stage").isNull())
    if s.skip_null_user:
        live = live.where(F.col("user_id").isNotNull())
    keys = list(dict.fromkeys([*batch, "user_id", "app_name"]))
    df = df.join(won(best_per_key(live, keys, "quality_score"), "_best"), "ord", "left")
    eligible = F.col("user_id").isNotNull() if s.skip_null_user else F.lit(True)
    lost = F.col("stage").isNull() & eligible & F.col("_best").isNull()
    return df.select("ord", F.when(lost, F.lit("user_duplicate")).otherwise(F.coalesce("stage", F.lit("kept")))
                     .alias("stage"))


#: The wide columns of cleaned rows, and the number by which a stage table of cleaned rows gives them to flagged rows.
TEXTS, ROW = ("content", "raw_content"), "_row"


def process(reviews: DataFrame, s: Settings | None = None, near_dup: bool = True, stage=None,
            texts: dict[str, Column] | None = None) -> DataFrame:
    """Flagged, classified rows for every row that passed cleaning.

    ``stage(name, build)`` may materialise stage outputs (``cleaned``,
    ``flagged``), e.g. ``plans.store.stage_table``; by default the whole
    pipeline stays one lazy plan.

    ``texts``: columns worked out of the cleaned rows in place of their texts (none: ``{}``).  The flags are found on rows
    without texts, so a report that needs little of the texts does not have them shuffled.
    """
    s = s or Settings()
    if stage is None:
        flagged = with_cleaned_content(flagged_rows(clean_rows(reviews, s), s, near_dup))
        return flagged if texts is None else flagged.withColumns(texts).drop(*TEXTS, "cleaned_content")
    cleaned = stage("cleaned", lambda: numbered(clean_rows(reviews, s)))
    flagged = stage("flagged", lambda: flagged_rows(cleaned, s, near_dup, stage, texts=False))
    if texts is not None:
        return with_texts(flagged, cleaned, texts)
    return with_cleaned_content(stage("wide", lambda: with_texts(flagged, cleaned, {c: F.col(c) for c in TEXTS})))


def clean_rows(reviews: DataFrame, s: Settings) -> DataFrame:
    return clean(reviews, s.min_length, s.max_length, s.decode, s.caps_on_original, s.as_of).drop("cleaned_content")


def numbered(cleaned: DataFrame) -> DataFrame:
    """With a number per row, for a stage table: read again, it stays (``ord`` may be null or repeat)."""
    return cleaned.withColumn(ROW, F.monotonically_increasing_id())


def with_texts(flagged: DataFrame, cleaned: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Flagged rows with columns worked out of their cleaned rows before the join, in the order of the cleaned rows."""
    names = list(dict.fromkeys(["ord", *(c for c in cleaned.columns if c in texts or c in flagged.columns and c not in ANEW),
                                *flagged.columns, *texts]))
    if texts:
        flagged = flagged.join(valid_rows(cleaned).select(ROW, *[e.alias(n) for n, e in texts.items()]), ROW)
    return flagged.select(*[c for c in names if c != ROW])


def flag_and_classify(cleaned: DataFrame, s: Settings, near_dup: bool = True, stage=None) -> DataFrame:
    """``process`` from rows that are cleaned already."""
    return with_cleaned_content(flagged_rows(cleaned, s, near_dup, stage))


#: Records may carry these from an earlier run; they are computed anew.
ANEW = ("content_hash", "quality_score", "spam_hits", "is_spam", "cleaned_content")


def flagged_rows(cleaned: DataFrame, s: Settings, near_dup: bool = True, stage=None, texts: bool = True) -> DataFrame:
    """Flags are computed on a narrow table (written once when stages are), then joined to the classified rows, which come
    without ``cleaned_content``, a copy of ``content``, and with ``texts=False`` without any texts."""
    stage = stage or (lambda name, build: build())
    wide = valid_rows(cleaned).drop(*ANEW)
    rows = stage("narrow", lambda: narrow(prepared(cleaned, s), s.batch))
    winners = None
    if near_dup and s.similarity_threshold is not None:
        from chorus.operators.neardup import near_duplicate_winners
        full = wide.join(rows.select("ord", "content_hash", "quality_score"), "ord")
        winners = near_duplicate_winners(full, s.batch, s.similarity_threshold, stage=stage)
    flags = flag_stages(rows, s, winners)
    marks = rows.select("ord", "content_hash", "quality_score", "spam_hits", "is_spam").join(flags, "ord")
    # Classified before the join: with the long texts gone, only narrow rows are shuffled.
    classified = classify(wide, s.lexicon, s.positive, s.negative, s.confidence_threshold, s.as_of)
    classified = classified.withColumn("_length", F.length(F.coalesce(F.col("content"), F.lit(""))))
    df = (classified if texts else classified.drop(*TEXTS)).join(marks, "ord")
    return finalize(df, s.as_of, F.col("_length")).drop("_length")


DUPLICATE_STAGES = ("hash_duplicate", "near_duplicate", "user_duplicate")


def finalize(df: DataFrame, as_of: str, length: Column | None = None) -> DataFrame:
    """Populate the record flags from ``stage`` (the original leaves them unset); ``length``: a column that holds the length of
    the content."""
    kept = F.col("stage") == "kept"
    df = df.withColumnRenamed("is_spam", "spam_predicate")
    df = df.withColumns({
        "is_spam": F.col("stage") == "spam",
        "is_duplicate": F.col("stage").isin(*DUPLICATE_STAGES),
        "processed_at": F.when(kept, F.lit(as_of)),
    })
    return df.withColumn("is_high_quality", is_high_quality(length=length))


def is_high_quality(min_score: float = LX.HIGH_QUALITY_MIN_SCORE, min_length: int = LX.HIGH_QUALITY_MIN_LENGTH, length=None):
    length = F.length(F.coalesce(F.col("content"), F.lit(""))) if length is None else length
    return (~F.coalesce(F.col("is_spam"), F.lit(False)) & ~F.coalesce(F.col("is_duplicate"), F.lit(False))
            & (F.coalesce(F.col("quality_score"), F.lit(0.0)) >= min_score)
            & (length >= min_length))


def documents_stage(spark: SparkSession, sf_dir: str, s: Settings, near_dup: bool = False):
    """A ``stage`` hook that writes each stage of the documents adapter's rows once per input and settings."""
    from chorus.plans.store import input_stamp, stage_table
    stamp = input_stamp(spark, f"{sf_dir}/documents.parquet")

    def stage(name, build):
        own = CLEAN_SETTINGS if name == "cleaned" else [*vars(s)]
        key = f"{name}|near={near_dup and name != 'cleaned'}|{stamp}|{[(k, getattr(s, k)) for k in own]}"
        return stage_table(spark, key, build)
    return stage


def cleaned_documents(spark: SparkSession, sf_dir: str, s: Settings | None = None) -> DataFrame:
    """The cleaned stage of ``documents_pipeline``: one table for both."""
    s = s or Settings()
    stage = documents_stage(spark, sf_dir, s)
    rows = stage("cleaned", lambda: numbered(clean_rows(reviews_from_documents(spark, sf_dir), s)))
    return with_cleaned_content(rows.drop(ROW))


def documents_pipeline(spark: SparkSession, sf_dir: str, near_dup: bool = False, materialize: bool = True,
                       texts: dict[str, Column] | None = None, **overrides) -> DataFrame:
    """The pipeline over the documents adapter with the test lexicons.

    With ``materialize`` the cleaned and flagged stages are written once as
    tables in the checkpoint folder and shared by every report.
    """
    s = Settings(**{**TEST_SETTINGS, **overrides})
    stage = documents_stage(spark, sf_dir, s, near_dup) if materialize else None
    return process(reviews_from_documents(spark, sf_dir), s, near_dup=near_dup, stage=stage, texts=texts)


#: The settings that cleaning depends on: its stage table is shared by runs that agree on them.
CLEAN_SETTINGS = ["as_of", "min_length", "max_length", "caps_on_original", "decode"]


def run(spark: SparkSession, inputs: Sequence[DataFrame | str], output: str | None = None, s: Settings | None = None,
        near_dup: bool = True, formats: Sequence[str] = ("csv", "json", "report")) -> DataFrame:
    """Collected sources to flagged reviews, and their exports under ``output``.

    ``inputs`` are review rows of any source (see ``sources.union``) or paths of batch JSON documents; a path that does
    not exist is skipped and logged, so that one source does not stop the others.
    """
    from chorus.plans.store import write_table
    from chorus.sources.union import collect, union_reviews
    rows = write_table(union_reviews(collect(spark, inputs)), "collected")
    flagged = process(rows, s, near_dup, stage=lambda name, build: write_table(build(), name))
    if output:
        from chorus.sinks.export import export_results
        export_results(flagged, output, formats)
    return flagged
