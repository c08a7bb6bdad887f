"""Whitening of embeddings by an incremental eigendecomposition.

Every task reads its vectors in batches. A centred batch is reduced to its triangular factor, whose rows have the
batch's scatter, and each of these rows is a rank-one update of the task's spectrum: the secular equation gives the
new eigenvalues, Loewner's formula the new vectors; directions that the update does not touch, and close eigenvalues
after a rotation, are deflated. The spectra of the tasks are combined in a tree, again by rank-one updates: the pairs
of one spectrum, scaled by the roots of their eigenvalues, and the difference of the means. A Rayleigh-Ritz step over
all rows then refines the basis: the covariance in that basis is summed exactly as it is and diagonalised, so errors
of the updates do not stay. What travels per task is one spectrum, dim x dim numbers, and trees of ``FAN_IN`` keep
the input of a merging task bounded. The driver holds one spectrum.

A component x of a vector c is ``floor(64 * c) + 1000000``; sums and deviations are whole numbers. Values of ``64 * c``
beyond ``LARGEST`` in size count as that. Vectors that are null, empty, or hold null or non-finite components are
left out, as are vectors whose length is not the most frequent one (of equally frequent lengths the longest).
Rows with equal or null ids each count. Components whose eigenvalue is not above ``NOISE`` times the largest carry no
variance, cannot be whitened and are left out, so equal vectors and a single one give no rows, like an empty table.
A deviation beyond a long becomes null. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = float(2**40)
COMPONENTS = 32
FAN_IN = 16
NOISE = 1e-12
_ROWS = 4096
_CELLS = 4_000_000


# ---- spectra ------------------------------------------------------------------


@dataclass
class Spectrum:
    """Count, mean and scatter, as eigenvalues (rising) and vectors, of some rows."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dim: int) -> Spectrum:
        return Spectrum(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """Take in ``n`` rows with this mean; ``rows`` have their centred scatter."""
        if not n:
            return
        for row in rows:
            self._update(row)
        if self.n:
            self._update((mean - self.mean) * np.sqrt(self.n * n / (self.n + n)))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def merge(self, other: Spectrum) -> None:
        self.add(other.n, other.mean, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)

    def _update(self, row: np.ndarray) -> None:
        z = self.vectors.T @ row
        if np.any(z):
            self.values, self.vectors = rank_one(self.values, self.vectors, z)


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of vectors (diag(values) + z z') vectors', eigenvalues rising."""
    order = np.argsort(values, kind="stable")
    d, z, u = values[order].copy(), z[order].copy(), vectors[:, order].copy()
    tol = 8 * np.finfo(float).eps * max(np.abs(d).max(), float(z @ z))
    live = np.flatnonzero(np.abs(z) * np.linalg.norm(z) > tol)
    for i, j in zip(live, live[1:], strict=False):
        # Two close eigenvalues: turn the pair so that the first is left out of the update.
        r = np.hypot(z[i], z[j])
        c, s = z[j] / r, z[i] / r
        if abs(c * s * (d[j] - d[i])) <= tol:
            u[:, i], u[:, j] = c * u[:, i] - s * u[:, j], s * u[:, i] + c * u[:, j]
            d[i], d[j] = c * c * d[i] + s * s * d[j], s * s * d[i] + c * c * d[j]
            z[i], z[j] = 0.0, r
    live = np.flatnonzero(np.abs(z) * np.linalg.norm(z) > tol)
    live = live[np.argsort(d[live], kind="stable")]
    if len(live):
        gaps, root = secular(d[live], z[live])
        # Loewner: the weights for which these roots are exact; with them the vectors are orthogonal.
        poles = d[live][None, :] - d[live][:, None]
        np.fill_diagonal(poles, 1.0)
        inside = gaps[:-1] / np.where(np.arange(len(live))[:, None] <= np.arange(len(live) - 1), poles[:, 1:], poles[:, :-1]).T if len(live) > 1 else np.ones((0, 1))
        weight = np.sqrt(np.abs(np.prod(inside, axis=0) * gaps[-1])) * np.sign(z[live])
        turn = weight[:, None] / gaps.T
        d[live] = root
        u[:, live] = u[:, live] @ (turn / np.linalg.norm(turn, axis=0))
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots r of 1 + sum z_j^2 / (d_j - r) = 0 for rising distinct d: (differences d_j - r_i by row i, roots).

    Root i lies between d_i and d_(i+1), the last one beyond d. Each is kept as the distance from the nearer end, so
    differences to the ends are exact; all are found at once by bisection.
    """
    square = z * z
    upper = np.append(d[1:], d[-1] + square.sum())
    k = np.arange(len(d))
    middle = (d + upper) / 2
    left = 1 + (square / (d[None, :] - middle[:, None])).sum(axis=1) >= 0
    left[-1] = True
    origin = np.where(left, k, np.minimum(k + 1, len(d) - 1))
    shifted = d[None, :] - d[origin][:, None]
    half = np.where(k == len(d) - 1, upper - d, (upper - d) / 2)
    low, high = np.where(left, 0.0, -half), np.where(left, half, 0.0)
    for _ in range(80):
        at = (low + high) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            above = 1 + (square / (shifted - at[:, None])).sum(axis=1) >= 0
        low, high = np.where(above, low, at), np.where(above, at, high)
    at = (low + high) / 2
    gaps = shifted - at[:, None]
    gaps = np.where(gaps == 0, np.finfo(float).tiny, gaps)
    return gaps, d[origin] + at


# ---- passes over the rows --------------------------------------------------------


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([column]).flatten()
    c = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST)


def _clean(vectors: DataFrame, id_col: str, embedding: str) -> tuple[DataFrame, int]:
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("vector"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & ~odd)
    dims = rows.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = dims[0]["dim"] if dims else 0
    return rows.where(F.size(v) == dim), dim


def _tree(parts: DataFrame, merge: Callable[[pd.DataFrame], pd.DataFrame], tasks: int) -> pd.DataFrame:
    """Merge the rows (part, ...) of all tasks, ``FAN_IN`` at a time."""
    while tasks > 1:
        level = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        parts = level.groupBy("part").applyInPandas(merge, parts.schema)
        tasks = -(-tasks // FAN_IN)
    left = parts.toPandas()
    return merge(left) if len(left) > 1 else left


def _partial(rows: DataFrame, reduce: Callable[[Iterator[np.ndarray]], dict], schema: str, dim: int) -> DataFrame:
    """One row per task that has rows: ``reduce`` of its batches of 64 * c, rounded down."""

    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = reduce(_chunks(batches, dim))
        if got:
            yield pa.RecordBatch.from_pylist([got]).select(names)

    return rows.select("vector").mapInArrow(run, schema).withColumn("part", F.spark_partition_id())


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """Matrices of some ``_CELLS`` numbers."""
    held, count = [], 0
    for batch in batches:
        for i in range(0, len(batch), _ROWS):
            held.append(_matrix(batch.column(0).slice(i, _ROWS), dim))
            count += len(held[-1])
            if count * dim >= _CELLS:
                yield np.concatenate(held)
                held, count = [], 0
    if held:
        yield np.concatenate(held)


@dataclass
class Whitener:
    """``n`` rows with the sums of x per dimension, the components (by column, eigenvalues falling) and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    reach: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        """Mean of 64 * c, rounded down: the mean of x without its constant."""
        return (self.sums - self.n * SHIFT).astype(np.float64) / self.n

    def apply(self, y: np.ndarray) -> np.ndarray:
        return (y - self.mean) @ self.components / np.sqrt(self.values)


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitener | None:
    """Three passes: sums and spectra, the covariance in the basis of the spectra, the covariance of the result."""
    tasks = rows.rdd.getNumPartitions()

    def spectra(chunks: Iterator[np.ndarray]) -> dict | None:
        spectrum, sums, low, high = Spectrum.empty(dim), np.zeros(dim, np.int64), np.inf, -np.inf
        for y in chunks:
            if len(y):
                mean = y.mean(axis=0)
                centred = y - mean
                spectrum.add(len(y), mean, np.linalg.qr(centred, mode="r") if len(y) > dim else centred)
                sums += y.astype(np.int64).sum(axis=0)
                low, high = min(low, y.min()), max(high, y.max())
        return _packed(spectrum, sums, low, high) if spectrum.n else None

    schema = "n long, low double, high double, sums array<long>, mean array<double>, eigen array<double>, basis array<double>"
    found = _tree(_partial(rows, spectra, schema, dim), lambda pdf: _merge_spectra(pdf, dim), tasks)
    if not len(found):
        return None
    top = found.iloc[0]
    n, sums = int(top["n"]), np.array(top["sums"], np.int64) + int(top["n"]) * SHIFT
    basis = np.linalg.qr(np.array(top["basis"]).reshape(dim, dim)[:, ::-1])[0]
    mean = (sums - n * SHIFT) / n

    second = _second_moments(rows, dim, tasks, lambda y: (y - mean) @ basis)
    offset, scatter = second
    ritz, turn = np.linalg.eigh((scatter - np.outer(offset, offset) / n) / n)
    order = np.argsort(ritz)[::-1]
    ritz, vectors = ritz[order], basis @ turn[:, order]
    kept = min(components, int((ritz > NOISE * max(ritz[0], 0)).sum())) if ritz[0] > 0 else 0
    model = Whitener(n, sums, vectors[:, :kept], ritz[:kept], float(ritz.sum()), float(top["high"] - top["low"]))
    if kept:
        offset, scatter = _second_moments(rows, dim, tasks, model.apply)
        model.identity_error = float(np.abs((scatter - np.outer(offset, offset) / n) / n - np.eye(kept)).max())
    return model


def _packed(s: Spectrum, sums: np.ndarray, low: float, high: float) -> dict:
    return {"n": s.n, "low": float(low), "high": float(high), "sums": sums, "mean": s.mean, "eigen": s.values, "basis": s.vectors.ravel()}


def _merge_spectra(pdf: pd.DataFrame, dim: int) -> pd.DataFrame:
    merged = Spectrum.empty(dim)
    for r in pdf.sort_values("n", ascending=False).itertuples():
        part = Spectrum(r.n, np.array(r.mean), np.array(r.eigen), np.array(r.basis).reshape(dim, dim))
        if merged.n:
            merged.merge(part)
        else:
            merged = part
    row = _packed(merged, np.sum(np.stack(pdf["sums"]), axis=0), pdf["low"].min(), pdf["high"].max())
    return pd.DataFrame([{**row, "part": pdf["part"].iloc[0]}])


def _second_moments(rows: DataFrame, dim: int, tasks: int, project: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the projected rows and sum of their outer products."""

    def moments(chunks: Iterator[np.ndarray]) -> dict | None:
        total, scatter = 0.0, 0.0
        for y in chunks:
            if len(y):
                p = project(y)
                total, scatter = total + p.sum(axis=0), scatter + p.T @ p
        return {"total": total, "scatter": scatter.ravel()} if np.ndim(total) else None

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {c: np.sum(np.stack(pdf[c]), axis=0) for c in ("total", "scatter")}
        return pd.DataFrame([{**row, "part": pdf["part"].iloc[0]}])

    got = _tree(_partial(rows, moments, "total array<double>, scatter array<double>", dim), merge, tasks).iloc[0]
    total = np.array(got["total"])
    return total, np.array(got["scatter"]).reshape(len(total), len(total))


# ---- result ------------------------------------------------------------------------


def whiten(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per vector and component."""
    rows, dim = _clean(vectors, id_col, embedding)
    model = fit(rows, dim, components) if dim else None
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        share = model.values / model.trace
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch.slice(i, _ROWS)
                y = _matrix(part.column(1), dim)
                m = len(y)
                numbers = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m))
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(again), numbers, pa.array(np.full(m * k, model.n, np.int64)),
                        _deviations(y, model).take(again), pa.array(model.apply(y).ravel()),
                        pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)


def _deviations(y: np.ndarray, model: Whitener) -> pa.Array:
    """Sum over the dimensions of (n * x - S)^2, exactly."""
    most = len(model.sums) * (model.n * (model.reach + 1)) ** 2
    if most < 2**62:
        x = y.astype(np.int64) + SHIFT
        return pa.array(((model.n * x - model.sums) ** 2).sum(axis=1))
    sums = [int(s) for s in model.sums]
    out = [sum((model.n * (int(v) + SHIFT) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in y]
    return pa.array([v if v < 2**63 else None for v in out], pa.int64())
