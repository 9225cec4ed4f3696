"""Approximate nearest neighbours: multi-index hashing.

Vectors get binary codes by a learned rotation (principal axes, then the rotation that brings them closest to
the corners of a cube).  A code is split into 8-bit substrings and each substring is indexed.  Two codes within
Hamming distance r share a substring within r // substrings (pigeonhole), so probing every value within that
distance retrieves every code within r; those are checked on the whole code, then reranked by exact cosine in
double precision.

The rotation and the radius are fitted on a bounded sample (``sample`` vectors, chosen by a hash of vec_id): the
radius is the smallest that keeps a share ``keep`` of the sample's own nearest neighbours, which lie farther apart
than those of the whole table.  The sample's pairs also say how far codes of a given cosine lie apart: a searched vector is
done when its radius covers what its own k-th score asks for, else it is searched again with that radius, and with twice
the radius as long as fewer than k + 1 vectors (or all, if the table has fewer) lie within it.  Every row is indexed.  Equal vectors are indexed once with their k + 1 smallest
ids (no more can be among the k nearest), and searched once, so large groups of copies cost one search.
Index rows are dealt by hash to shards of bounded size and queries to blocks of bounded size; each pair of a block
and a shard is one task's work.

Defined cases: equal scores go to the smaller id; vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of
another length than most; rows with a null id take no part; repeated ids count once per distinct vector; with fewer
candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import hashed_sample, stage, table

#: Cells of cosine in the calibration of radii.
CELLS = 80
POPCOUNT = np.array([bin(v).count("1") for v in range(256)], np.uint8)
BYTE_DISTANCE = POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


class RotatedCodes:
    """Binary codes of unit vectors under a learned rotation."""

    def __init__(self, unit: np.ndarray, bits: int = 64, rounds: int = 30, seed: int = 5) -> None:
        bits = min(bits, unit.shape[1])
        self.mean = unit.mean(0)
        centred = unit - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        projection = axes[:, ::-1][:, :bits]
        y = centred @ projection
        rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(y @ rotation > 0, 1.0, -1.0).T @ y)
            rotation = vt.T @ u.T
        self.matrix = projection @ rotation

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits((unit - self.mean) @ self.matrix > 0, axis=1)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return POPCOUNT[codes ^ code].sum(1, dtype=np.int64)


def fit_radius(codes: np.ndarray, unit: np.ndarray, k: int, keep: float, queries: int = 1000) -> int:
    """Smallest radius within which a share ``keep`` of the k nearest of the first ``queries`` rows lie."""
    n = min(queries, len(unit))
    near = unit[:n] @ unit.T
    near[np.arange(n), np.arange(n)] = -2
    k = min(k, len(unit) - 1)
    if k < 1:
        return 8 * codes.shape[1]
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    far = np.sort(np.concatenate([hamming(codes[top[i]], codes[i]) for i in range(n)]))
    return int(far[min(len(far) - 1, ceil(keep * len(far)) - 1)])


def calibrate(codes: np.ndarray, unit: np.ndarray, keep: float, queries: int = 1000) -> list[int]:
    """By cell of cosine (from -1 up to 1): a radius that holds a share ``keep`` of the sample's pairs of each cell from there
    up.  Cells without pairs take the radius of the next lower one, and the lowest all bits."""
    n, bits = min(queries, len(unit)), 8 * codes.shape[1]
    counts = np.zeros((CELLS, bits + 1), np.int64)
    for i in range(n):
        cell = np.clip(((unit @ unit[i] + 1) / 2 * CELLS).astype(np.int64), 0, CELLS - 1)
        far = hamming(codes, codes[i])
        others = np.arange(len(unit)) != i
        np.add.at(counts, (cell[others], far[others]), 1)
    radii, below = [], bits
    for cell in counts:
        if cell.sum():
            below = int(np.searchsorted(np.cumsum(cell), keep * cell.sum()))
        radii.append(below)
    return np.maximum.accumulate(radii[::-1])[::-1].tolist()


class SubstringIndex:
    """The substrings of a shard's codes, each sorted by value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.begins = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Positions of all codes within ``radius``."""
        hit = np.zeros(len(self.codes), bool)
        reach = radius // len(self.order)
        for j, (order, begin) in enumerate(zip(self.order, self.begins)):
            probes = np.flatnonzero(BYTE_DISTANCE[code[j]] <= reach)
            # Neighbouring values form one run of the sorted substring.
            cuts = np.flatnonzero(np.diff(probes) > 1)
            for a, b in zip(probes[np.r_[0, cuts + 1]], probes[np.r_[cuts, len(probes) - 1]]):
                hit[order[begin[a]: begin[b + 1]]] = True
        found = np.flatnonzero(hit)
        return found[hamming(self.codes[found], code) <= radius]


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(good & some, F.lit(False))))


def unit_rows(values: list) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(values).astype(np.float64)
    # Two steps keep very large and very small components finite.
    x = x / np.abs(x).max(1, keepdims=True)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(rows: DataFrame, is_query: F.Column, k: int = 5, vector: str = "embedding", sample: int = 8192,
            keep: float = 0.985, bits: int = 64, shard_rows: int = 8192, block_queries: int = 512) -> DataFrame:
    """The k nearest found of each query row: (query_id, rank, vec_id, score)."""
    spark = rows.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    usual = usable(rows, vector)
    sizes = usual.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    usual = usual.where(F.size("v") == sizes.n)
    # One row per distinct vector; the k + 1 smallest ids through partial sums of bounded arrays.
    salted = (usual.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
              .agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids")))
    distinct = stage(salted.groupBy("v").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
        .withColumn("key", F.col("ids")[0]), "ann-index")
    chosen = [r.v for r in hashed_sample(distinct, sample, "key").orderBy(F.xxhash64("key"), "key").collect()]
    _, unit = unit_rows(chosen)
    codes = RotatedCodes(unit, bits)
    radius, radii = fit_radius(codes(unit), unit, k, keep), calibrate(codes(unit), unit, keep)

    n = distinct.count()
    asked = usual.where(is_query).join(distinct.select("v", "key"), "v").select("key", "vec_id")
    asked = stage(asked.distinct(), "ann-queries")
    heads = asked.select("key").distinct()
    n_heads = heads.count()
    if not n_heads:
        return spark.createDataFrame([], empty)
    shards = ceil(n / shard_rows)

    def spread(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        """Deal rows by hash to ``own`` and repeat them for every ``other``: work in blocks."""
        return (df.withColumn(own, F.pmod(F.xxhash64("key"), F.lit(own_n)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_n - 1).cast("long")))))

    found_schema = "key long, near long, score double, ids array<long>"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            scaled, unit = unit_rows(left["v"].tolist())
            table_ = SubstringIndex(codes(unit))
            keys, ids, norms = left["key"].to_numpy(), left["ids"].tolist(), np.linalg.norm(scaled, axis=1)
            asked_scaled, asked_unit = unit_rows(right["v"].tolist())
            for key, radius, q, code in zip(right["key"].tolist(), right["radius"].tolist(), asked_scaled, codes(asked_unit)):
                at = table_.within(code, radius)
                score = (scaled[at] @ q) / (norms[at] * np.linalg.norm(q))
                best = at[np.lexsort((keys[at], -score))[: k + 1]]
                values = dict(zip(at.tolist(), score.tolist()))
                out += [(key, keys[p], values[p], ids[p]) for p in best.tolist()]
        return pd.DataFrame(out, columns=["key", "near", "score", "ids"])

    order = F.struct((-F.col("score")).alias("far"), F.col("near"), F.col("score"), F.col("ids"))

    def best_within(asking: DataFrame, blocks: int) -> DataFrame:
        """(key, radius, best): the k + 1 nearest distinct vectors within the radius of each asking key."""
        index = spread(distinct, "shard", shards, "block", blocks)
        # New column identities: both sides of the cogroup come from one table.
        searched = distinct.join(asking, "key").select(F.col("key").alias("key"), F.col("v").alias("v"), "radius")
        queries = spread(searched, "block", blocks, "shard", shards)
        found = (index.groupBy("block", "shard").cogroup(queries.groupBy("block", "shard"))
                 .applyInPandas(search, found_schema))
        # At most k + 1 rows of a key come from a shard.
        best = found.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k + 1).alias("best"))
        return asking.join(best, "key", "left")

    all_bits, enough = 8 * codes(unit[:1]).shape[1], min(k + 1, n)
    cell = F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.floor((F.element_at("best", -1)["score"] + 1) / 2 * CELLS)))
    asks = F.element_at(F.array(*map(F.lit, radii)), (cell + 1).cast("int"))
    wider = F.least(F.lit(all_bits), F.greatest(2 * F.col("radius"), F.lit(8)))
    needed = F.when(F.size("best") >= enough, asks).otherwise(wider)
    done: list[DataFrame] = []
    heads = heads.withColumn("radius", F.lit(radius))
    while n_heads:
        best = stage(best_within(heads, ceil(n_heads / block_queries)).withColumn("needed", F.coalesce(needed, wider)),
                     "ann-best")
        full = (F.col("radius") >= F.col("needed")) | (F.col("radius") >= all_bits)
        done.append(best.where(full & F.col("best").isNotNull()).select("key", "best"))
        heads = stage(best.where(~full).select("key", F.col("needed").alias("radius")), "ann-short")
        n_heads = heads.count()
    best = reduce(DataFrame.unionByName, done)
    # Members of those vectors by score, then id; a query's own id goes, k stay.
    member = F.flatten(F.transform("best", lambda b: F.transform(
        b["ids"], lambda i: F.struct(b["far"].alias("far"), i.alias("vec_id"), b["score"].alias("score")))))
    ranked = (asked.join(best, "key")
              .select(F.col("vec_id").alias("query_id"), F.array_sort(member).alias("m"))
              .select("query_id", F.slice(F.filter("m", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("m")))
    return (ranked.select("query_id", F.posexplode("m").alias("p", "x"))
            .select("query_id", (F.col("p") + 1).cast("int").alias("rank"),
                    F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")))


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, among all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
