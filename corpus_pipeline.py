"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

quality    documents that the pairwise-ranking classifier rejects go
jaccard    one row of each component of the Jaccard join stays (5-word shingles, similarity 0.8 or more)
benchmark  documents that contain a benchmark item (0.8 of its 5-word shingles or more) go
pii        personal data in texts is replaced by its kind; n_chars follows the text
packing    documents are tokenised and packed into sequences of 1024 ids

Defined cases: null and empty texts are scored like others, link with nothing, hold no item, and pack as the end id alone;
rows with null or repeated ids are judged as rows of their own; very long texts are read whole; extra columns are kept up to
the last stage, whatever their names; an empty table gives an empty result.

All but the last return the columns of documents; the last returns one row per piece with its place.  As a whole they have no
form in SQL (trained models, tokenizers), so ORACLE_SQL is None; tests check the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import new_folder, table, tokenizer_path
from chorus.llm.containment import decontaminate_rows
from chorus.llm.jaccard import keep_first
from chorus.llm.packing import pack_documents
from chorus.llm.pii import fit_finder, redact
from chorus.llm.quality import accepted, fit_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier accepts; it learns from labelled documents of its own input."""
    return accepted(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate_rows(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact(docs, fit_finder(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("jaccard", near_duplicates), ("benchmark", benchmark), ("pii", personal_data),
          ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; intermediate tables lie in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
