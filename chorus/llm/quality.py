"""Quality classifier: Bradley-Terry pairwise ranking.

Each preference pair holds a document marked good and one marked bad; the logistic loss of the difference of
their features gives the weights of a linear score.  The threshold is a quantile of the training scores: the
one that best separates the two classes there.  A score of ``accept`` (0.3) lies exactly at the threshold.

Features come from the whole text and nothing else.  Weights are fitted on a bounded sample of labelled rows
(``sample`` rows, chosen by a hash of doc_id, and ``pairs`` pairs); every document is scored.

Defined cases: null and empty texts have all features zero and get that score; rows with a null doc_id are
scored and count as not held out; repeated rows get equal scores; without labels of both classes every
document scores 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chorus.llm.common import doc_bucket, hashed_sample, table, text_bytes

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = b"!#$%&*+/<=>?@[\\]^_`{|}~"
ENDS = b".,;:'\"-()"
SPACES = b" \t\n\r\x0b\x0c"


def features(text: bytes) -> list[float]:
    """Shares and logarithms that describe the form of a text."""
    n = len(text)
    words = text.split()
    m = len(words)
    if m == 0:
        return [0.0] * N_FEATURES

    def share(chars: bytes) -> float:
        return (n - len(text.translate(None, chars))) / n

    distinct = len(set(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_set = set(lines)
    again = sum(map(eq, words, words[1:])) / m
    pairs = len(set(zip(words, words[1:]))) / m
    upper, marks = share(UPPER), share(MARKS)
    return [
        log(m), distinct / m, distinct / m ** 0.9, again, pairs, again ** 0.5,
        upper, min(1.0, upper * 10), marks, min(1.0, marks * 20), share(DIGITS), share(ENDS), share(SPACES),
        n / m / 10, len(lines) / m, len(line_set) / len(lines), log(1 + n / len(lines)),
        share(b"|"), share(b"!"), text.count(b"http") / m, float(m < 20),
    ]


N_FEATURES = 21


def feature_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` as r0, r1, ... (so that no name can clash) and a ``features`` array for every row."""
    rows = docs.select(*(F.col(f"`{name}`").alias(f"r{k}") for k, name in enumerate(keep)), text_bytes().alias("text"))
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(got, pa.list_(pa.float64()))],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


class BradleyTerry:
    """Weights fitted on preference pairs, and the score that maps the threshold to ``accept``."""

    def __init__(self, pairs: int = 60_000, penalty: float = 1e-3, accept: float = 0.3, seed: int = 7) -> None:
        self.pairs, self.penalty, self.accept, self.seed = pairs, penalty, accept, seed
        self.weights = np.zeros(N_FEATURES)
        self.mean, self.scale, self.shift = np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.0

    def fit(self, x: np.ndarray, good: np.ndarray) -> BradleyTerry:
        """``x``: one row of features per document; ``good``: whether it is preferred."""
        if not len(x) or good.all() or not good.any():
            return self
        rng = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = (x - self.mean) / self.scale
        won = rng.choice(np.flatnonzero(good), self.pairs)
        lost = rng.choice(np.flatnonzero(~good), self.pairs)
        d, w = z[won] - z[lost], self.weights
        for _ in range(30):  # Newton steps on the mean of log(1 + exp(-d w)) and the penalty
            p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
            gradient = -(d * p[:, None]).mean(0) + self.penalty * w
            curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + self.penalty * np.eye(len(w))
            step = np.linalg.solve(curve, gradient)
            w = w - step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        self.weights = w
        raw = z @ w
        order = np.argsort(raw, kind="stable")
        bad_below = np.cumsum(~good[order]) / (~good).sum()
        good_below = np.cumsum(good[order]) / good.sum()
        cut = int(np.argmax(bad_below - good_below))  # how many of the sample lie at or below the quantile
        self.shift = float(raw[order[[cut, min(cut + 1, len(order) - 1)]]].mean())
        return self

    def threshold_quantile(self, x: np.ndarray) -> float:
        """Share of rows of ``x`` that score below the threshold."""
        return float((((x - self.mean) / self.scale) @ self.weights < self.shift).mean())

    def column(self, features_col: str = "features") -> F.Column:
        """The score as a native expression over the features array."""
        if not self.weights.any():
            return F.lit(0.5)
        w = self.weights / self.scale
        bias = -float(self.mean @ w) - self.shift + log(self.accept / (1 - self.accept))
        terms = [F.col(features_col)[k] * F.lit(float(v)) for k, v in enumerate(w)]
        raw = F.lit(bias)
        for t in terms:
            raw = raw + t
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), raw))))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 12_000, folds: int = 5) -> BradleyTerry:
    """Fit on at most ``sample`` labelled rows outside the held-out fold (crc32(doc_id) mod folds = 0)."""
    marked = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .where(doc_bucket("doc_id") % folds != 0)
              .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    chosen = hashed_sample(marked, sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Repeated doc_ids may bring more rows than ids: the bound holds for rows, too.
    rows = feature_rows(rows, ["doc_id", "quality"]).distinct()
    got = rows.orderBy(F.xxhash64("r0", "features"), "r0", "features").limit(2 * sample).collect()
    x = np.array([r.features for r in got]).reshape(len(got), N_FEATURES)
    return BradleyTerry().fit(x, np.array([r.r1 == 1 for r in got], bool))


def score_documents(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``."""
    scored = feature_rows(docs, ["doc_id"]).select(F.col("r0").alias("doc_id"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= model.accept).cast("int"))


def accepted(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """The rows of ``docs`` that the model accepts."""
    rows = feature_rows(docs, docs.columns).where(model.column() >= model.accept)
    return rows.select(*(F.col(f"r{k}").alias(name) for k, name in enumerate(docs.columns)))


def op4_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(doc_bucket("doc_id") % 5 == 0, F.lit(False))
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
