"""Topic and sentiment classification as one projection (no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus import lexicons as LX
from chorus.functions.scores import add_classification


def classify(df: DataFrame, lexicon=None, positive=None, negative=None,
             threshold: float = LX.CONFIDENCE_THRESHOLD, as_of: str | None = None,
             title: str = "title", content: str = "content") -> DataFrame:
    """Add primary_category, category_scores, classification_confidence,
    sentiment, sentiment_score, keywords_found and classified_at."""
    out = add_classification(df, title, content, lexicon, positive, negative, threshold)
    return out.withColumn("classified_at", F.lit(as_of).cast("string"))
