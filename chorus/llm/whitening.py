"""Embedding whitening: principal components by QDWH spectral divide and conquer.

1. Each vector becomes integers, x = floor(64 c) + 1000000.  The fit list is each distinct x once.
2. Exact sums, then products of centred values, are added up within tasks and over tasks; only n, S and one d x d matrix
   come to the driver (d is the vectors' dimension; neither grows with the rows).
3. The covariance is split by its spectrum: the polar factor U of V - shift I (QDWH iterations: QR factorisations with
   dynamic weights) has the eigenvalues +1 and -1, (I + U) / 2 and (I - U) / 2 project on the invariant subspaces above and
   below the shift, and V restricted to each is split again, until subspaces are single directions (or V is a multiple
   of the identity there, where any basis is right).
4. The components and scales, at most 16 x d numbers, go to all tasks, which whiten every row.

Defined cases: vectors that are null, empty, or hold null or non-finite entries take no part, neither do vectors of
another length than the most frequent (of equally frequent lengths the larger); repeated rows count once in the fit and are
returned each; null vec_ids are rows like others; equal eigenvalues give some orthonormal basis of their subspace, the same
for all rows; directions without variance (eigenvalue up to 1e-12 of the largest) are no components, so a table of one
distinct vector, and an empty one, give no rows; a deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import stage, table

EPS = float(np.finfo(float).eps)
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def weights(low: float) -> tuple[float, float, float]:
    """QDWH's weights for singular values in [low, 1]."""
    d = (4 * (1 - low ** 2) / low ** 4) ** (1 / 3)
    a = (1 + d) ** 0.5 + 0.5 * (8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * (1 + d) ** 0.5)) ** 0.5
    b = (a - 1) ** 2 / 4
    return a, b, a + b - 1


def polar(a: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix without zero eigenvalues: its matrix sign."""
    x = a / np.linalg.norm(a)
    try:
        low = max(EPS, min(1.0, 0.9 / np.linalg.norm(np.linalg.inv(x))))
    except np.linalg.LinAlgError:
        low = EPS
    eye = np.eye(len(a))
    for _ in range(rounds):
        wa, wb, wc = weights(min(low, 1 - 1e-15))
        q, _ = np.linalg.qr(np.vstack([wc ** 0.5 * x, eye]))
        fresh = wb / wc * x + (wa - wb / wc) / wc ** 0.5 * q[: len(a)] @ q[len(a):].T
        fresh = (fresh + fresh.T) / 2
        low = min(1.0, low * (wa + wb * low ** 2) / (1 + wc * low ** 2))
        moved, x = np.linalg.norm(fresh - x), fresh
        if moved < 1e-13 * len(a) ** 0.5 and 1 - low < 1e-12:
            break
    return x


def split(a: np.ndarray, tiny: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if no shift parts ``a``."""
    n, diagonal = len(a), np.sort(np.diag(a))
    rng = np.random.default_rng(n)
    spread = max(diagonal[-1] - diagonal[0], np.linalg.norm(a - np.diag(np.diag(a))))
    best = None
    for shift in (np.median(diagonal), diagonal.mean(), *(diagonal.mean() + spread * s for s in rng.normal(size=12) / 8)):
        u = polar(a - shift * np.eye(n))
        above = (np.eye(n) + u) / 2
        k = round(float(np.trace(above)))
        if not 0 < k < n:
            continue
        # The projectors' ranges, each refined by one more projection.
        upper, _ = np.linalg.qr(above @ rng.normal(size=(n, k)))
        upper, _ = np.linalg.qr(above @ upper)
        lower = (np.eye(n) - above) @ rng.normal(size=(n, n - k))
        basis, _ = np.linalg.qr(np.hstack([upper, lower]))
        leak = np.linalg.norm(basis[:, :k].T @ a @ basis[:, k:])
        if best is None or leak < best[0]:
            best = leak, basis[:, :k], basis[:, k:]
        if leak <= tiny:
            break
    return best and best[1:]


def components_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the largest down, unit eigenvectors as columns) of a symmetric matrix."""
    size = np.linalg.norm(v)
    tiny = 4 * EPS * size * len(v) ** 0.5
    done: list[np.ndarray] = []
    todo = [np.eye(len(v))]
    while todo:
        basis = todo.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        apart = a - np.eye(len(a)) * np.trace(a) / len(a)
        parts = None if len(a) == 1 or np.linalg.norm(apart) <= tiny else split(a, tiny)
        if parts is None:
            done += list(basis.T)
        else:
            todo += [basis @ p for p in parts]
    vectors = np.array(done).T
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(v))])
    return values[order], vectors * signs


def whole_numbers(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    number = F.col(column).cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("c"))
    finite = F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = rows.where(F.col("c").isNotNull() & (F.size("c") > 0) & finite)
    sizes = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("c") == (sizes.d if sizes else 0))
    return rows.select("vec_id", F.transform("c", lambda e: F.floor(e * 64) + F.lit(1_000_000)).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def added(fit: DataFrame, cells: int, add: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all rows of the fit list of ``add``'s ``cells`` numbers: within each task, then over tasks by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            total += add(matrix(batch.column(0), d)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["part"])

    parts = fit.select("x").mapInArrow(run, "part array<double>")
    got = parts.select(F.posexplode("part").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(cells)
    for row in got:
        out[row.cell] = row.v
    return out


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(number of rows, sums by dimension) without rounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            if len(x) and np.abs(x).max() >= 1 << 40:
                x = x.astype(object)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in (n, *total)]])], names=["part"])

    parts = fit.select("x").mapInArrow(run, "part array<string>")
    got = (parts.select(F.posexplode("part").alias("cell", "v")).groupBy("cell")
           .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("cell").collect())
    n, *sums = (int(row.v) for row in got)
    return n, sums


class Whitening:
    """What the fit list gives: n, exact sums, components, scales and the whitened fit list's distance from the identity."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n / n for s in sums])
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exactly; None beyond a long."""
        far = np.abs(self.centred(x)).max(initial=0) * self.n
        if far ** 2 * x.shape[1] < 2.0 ** 62 and np.abs(x).max(initial=0) * float(self.n) < 2.0 ** 62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return [e if e < 1 << 63 else None for e in exact]


def fit_whitening(x: DataFrame, most: int = 16) -> Whitening | None:
    """Fit on the distinct vectors of ``x``; None if there are none or they do not vary."""
    fit = stage(x.select("x").distinct(), "whitening-fit")
    first = fit.first()
    if first is None:
        return None
    d = len(first.x)
    n, sums = exact_sums(fit, d)
    bare = Whitening(n, sums, np.ones(0), np.zeros((d, 0)), 0.0)

    def products(rows: np.ndarray) -> np.ndarray:
        c = bare.centred(rows)
        return c.T @ c

    v = added(fit, d * d, products, d).reshape(d, d) / n
    v = (v + v.T) / 2
    values, vectors = components_of(v)
    use = np.flatnonzero(values > 1e-12 * max(values[0], 0.0))[:most]
    if values[0] <= 0 or not len(use):
        return None
    found = Whitening(n, bare.sums, values[use], vectors[:, use], float(np.trace(v)))
    m = len(use)

    def moments(rows: np.ndarray) -> np.ndarray:
        y = found.whitened(rows)
        return np.vstack([y.sum(0), y.T @ y])

    total = added(fit, (m + 1) * m, moments, d).reshape(m + 1, m) / n
    covariance = total[1:] - np.outer(total[0], total[0])
    found.identity_error = float(np.abs(covariance - np.eye(m)).max())
    return found


def whiten(embeddings: DataFrame, column: str = "embedding", most: int = 16) -> DataFrame:
    """One row per vector and component (columns of OUT)."""
    spark = embeddings.sparkSession
    x = whole_numbers(embeddings, column)
    model = fit_whitening(x, most)
    if model is None:
        return spark.createDataFrame([], OUT)
    shared = spark.sparkContext.broadcast(model)
    m, d = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        explained = model.values / model.trace
        for batch in batches:
            rows = matrix(batch.column(1), d)
            k = len(rows)
            each = np.repeat(np.arange(k), m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                 pa.array(np.full(k * m, model.n)), pa.array(model.deviations(rows), pa.int64()).take(pa.array(each)),
                 pa.array(model.whitened(rows).reshape(-1)), pa.array(np.tile(explained, k)),
                 pa.array(np.full(k * m, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, OUT)


def op13_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on its whitened leading 16 components."""
    return whiten(table(spark, sf_dir, "embeddings"))
