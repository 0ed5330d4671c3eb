"""Embedding whitening: principal components by QDWH spectral divide-and-conquer, applied on Spark.

Counts, sums and the centred cross products of all vectors are added up on Spark. The covariance, a
matrix of the vectors' length, is split on the driver: the polar factor of a shifted matrix, found by
the QDWH iteration, is the sign of its eigenvalues, so half of it plus the identity projects onto the
invariant subspace above the shift. Both subspaces are split again until blocks are diagonal. The
components are broadcast and every vector is projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftgrain.llm.common import slices, stage
from shiftgrain.llm.partials import matrix, total

EPS = float(np.finfo(float).eps)
#: Components are kept whose eigenvalue is above this part of the largest one.
FLOOR = 1e-12
#: Integers are exact as doubles up to here; larger entries count as this.
EDGE = 1 << 53
ROWS = 4096


def polar(a: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps.

    Steps use a QR factorisation while the weight is large and a Cholesky factorisation after that.
    An eigenvalue of exactly zero has no sign; its direction may end between -1 and 1.
    """
    m = len(a)
    scale = np.linalg.norm(a)
    if not scale:
        return np.eye(m)
    x, low, one = a / scale, EPS, np.eye(m)
    for _ in range(rounds):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))[0]
            new = q / r * x + (p - q / r) / np.sqrt(r) * both[:m] @ both[m:].T
        else:
            lower = np.linalg.cholesky(one + r * x.T @ x)
            new = q / r * x + (p - q / r) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        new = (new + new.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + r * square))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(5 * EPS) and abs(low - 1) <= 10 * EPS:
            break
    return x


def _split(b: np.ndarray, shift: float, seed: int) -> tuple[np.ndarray, int, float]:
    """(orthogonal basis, its first columns spanning the subspace above `shift`; their number; what is left between both)."""
    m = len(b)
    above = (polar(b - shift * np.eye(m)) + np.eye(m)) / 2
    k = int(round(float(np.trace(above))))
    if not 0 < k < m:
        return np.eye(m), k, np.inf
    start = np.random.default_rng(seed).standard_normal((m, k))
    for _ in range(2):
        basis = np.linalg.qr(above @ start, mode="complete")[0]
        start = basis[:, :k]
    return basis, k, float(np.linalg.norm(basis[:, k:].T @ b @ basis[:, :k]))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the largest, eigenvectors as columns) of a symmetric matrix by spectral divide-and-conquer."""
    whole = np.linalg.norm(a)
    values, vectors = np.empty(len(a)), np.eye(len(a))
    todo = [(0, (a + a.T) / 2, np.eye(len(a)))]
    while todo:
        at, b, basis = todo.pop()
        m, diagonal = len(b), np.diag(b).copy()
        if m == 1 or np.linalg.norm(b - np.diag(diagonal)) <= EPS * whole:
            values[at : at + m], vectors[:, at : at + m] = diagonal, basis
            continue
        ranked = np.sort(diagonal)
        gap = int(np.diff(ranked).argmax())
        best = None
        # The mean always lies inside the spectrum; the median splits evenly, the widest gap cleanly.
        for turn, shift in enumerate((float(np.median(diagonal)), float((ranked[gap] + ranked[gap + 1]) / 2), float(diagonal.mean()))):
            found = _split(b, shift, turn)
            if best is None or found[2] < best[2]:
                best = found
            if best[2] <= 10 * EPS * m * whole:
                break
        turned, k, rest = best
        if not np.isfinite(rest):  # no shift tells the eigenvalues apart: they are equal to rounding
            values[at : at + m], vectors[:, at : at + m] = diagonal, basis
            continue
        new = turned.T @ b @ turned
        new = (new + new.T) / 2
        todo.append((at, new[:k, :k], basis @ turned[:, :k]))
        todo.append((at + k, new[k:, k:], basis @ turned[:, k:]))
    values, vectors = _refined(a, vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _refined(a: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One correction of first order: what rounding left between components that have different eigenvalues."""
    short = np.eye(len(a)) - vectors.T @ vectors
    inner = vectors.T @ a @ vectors
    values = np.diag(inner) / (1 - np.diag(short))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > 1e-5 * max(np.linalg.norm(a), np.finfo(float).tiny)
    turn = np.where(far, (inner + values[None, :] * short) / np.where(far, apart, 1.0), short / 2)
    np.fill_diagonal(turn, np.diag(short) / 2)
    vectors = vectors + vectors @ turn
    return np.einsum("ik,ij,jk->k", vectors, a, vectors) / (vectors**2).sum(0), vectors / np.sqrt((vectors**2).sum(0))


def integer_rows(rows: DataFrame, id_col: str, vector_col: str, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id long, x array<long>): floor(scale * c) + offset of vectors without null or non-finite entries.

    Only vectors of the commonest length (of equally common ones the longest) can share a covariance;
    others do not appear, nor do vectors of no entries. Repeated and null ids keep all their rows.
    """
    near = lambda c: F.greatest(F.lit(-float(EDGE)), F.least(F.lit(float(EDGE)), c * scale))
    whole = (
        rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        .where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
        .select("vec_id", F.transform("v", lambda c: F.floor(near(c)) + offset).alias("x"))
    )
    found = stage(whole)
    lengths = found.groupBy(F.size("x").alias("m")).count().orderBy(F.desc("count"), F.desc("m")).limit(1).collect()
    return found.where(F.size("x") == lengths[0]["m"]) if lengths else found


@dataclass
class Whitening:
    """Components of the covariance of all fitted vectors; `sums` are exact."""

    count: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def base(self) -> np.ndarray:
        """Integers just below the mean: vectors are centred exactly on them, then by the fraction that is left."""
        return np.array([s // self.count for s in self.sums], np.int64)

    @property
    def fraction(self) -> np.ndarray:
        return np.array([(s % self.count) / self.count for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.fraction

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of squares of count * x - sums, as integers of any size."""
        off = x - self.base
        most = self.count * (int(np.abs(off).max(initial=0)) + 1)
        rest = [s % self.count for s in self.sums]
        if most * most * x.shape[1] < 1 << 63:
            return ((off * self.count - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        return [sum((int(v) * self.count - r) ** 2 for v, r in zip(row, rest)) for row in off]


def fit(vectors: DataFrame, limit: int = 32) -> Whitening | None:
    """Up to `limit` components of all rows of (vec_id, x); None without rows. Equal rows give no component."""
    first = vectors.select("x").head()
    if first is None:
        return None
    dims = len(first["x"])

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch.column("x"), dims)
        return np.r_[[len(x)], (x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0)]

    added = total(vectors.select("x"), sums, np.int64)
    count = int(added[0])
    exact = [(int(h) << 26) + int(low) for h, low in zip(added[1 : dims + 1], added[dims + 1 :])]
    out = Whitening(count, exact, np.empty(0), np.empty((dims, 0)), 0.0)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        grid = np.zeros((dims, dims))
        for part in slices([batch], ROWS):
            z = out.centred(matrix(part.column("x"), dims))
            grid += z.T @ z
        return grid.ravel()

    covariance = total(vectors.select("x"), products, np.float64).reshape(dims, dims) / count
    values, components = eigen(covariance)
    keep = min(limit, int((values > FLOOR * max(values[0], 0.0)).sum()))
    return Whitening(count, exact, values[:keep], components[:, :keep], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    dims, k = model.vectors.shape

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        grid = np.zeros((k + 1, k))
        for part in slices([batch], ROWS):
            w = model.project(matrix(part.column("x"), dims))
            grid[:k] += w.T @ w
            grid[k] += w.sum(0)
        return grid.ravel()

    grid = total(vectors.select("x"), moments, np.float64).reshape(k + 1, k) / model.count
    return float(np.abs(grid[:k] - np.outer(grid[k], grid[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation decimal(38, 0), whitened array<double>) of every row; a deviation beyond the type is null."""
    dims, k = model.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            x = matrix(batch.column("x"), dims)
            w = model.project(x)
            far = [Decimal(v) if v < 10**38 else None for v in model.deviations(x)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(far, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whitened_components(rows: DataFrame, id_col: str, vector_col: str, limit: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Directions without variance have no component: fewer than `limit` then appear, and none where all
    vectors are equal or there is no vector. See `integer_rows` for the rows that take part.
    """
    vectors = integer_rows(rows, id_col, vector_col)
    model = fit(vectors, limit)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame(
            [], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        )
    error = identity_error(vectors, model)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return (
        whiten(vectors, model)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
        .select(
            "vec_id", (F.col("component") + 1).cast("int").alias("component"), F.lit(model.count).cast("long").alias("n"), "deviation", "whitened",
            F.get(shares, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"),
        )
    )
