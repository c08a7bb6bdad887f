"""Vector arithmetic: Column builders for any plan, Arrow kernels for the hot path.

Spark evaluates array lambdas one element at a time. The Arrow kernels do the
same arithmetic on whole batches and are used wherever every row of a big
table is scored. Only the columns a kernel needs travel to Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Similarities are compared after rounding, so equal vectors tie exactly.
SIMILARITY_DIGITS = 12
# Elements of one intermediate similarity matrix (32 MB of doubles).
MATRIX_CELLS = 4_000_000


def doubles(col: Column) -> Column:
    return col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; NULL when either vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def diag_mahalanobis(x: Column, centroid: Column, variance: Column, epsilon: float = 1e-6) -> Column:
    """Distance scaled by each dimension's variance; NULL instead of NaN."""
    diff = F.zip_with(doubles(x), doubles(centroid), lambda p, q: p - q)
    scaled = F.zip_with(diff, doubles(variance), lambda d, v: d * d / (v + F.lit(epsilon)))
    return number(F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, v: s + v)))


def number(col: Column) -> Column:
    """The value, or NULL when it is NaN."""
    return F.when(~F.isnan(col), col)


def effective_k(n: Column, k: int, samples_per_cluster: int = 30) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(k), F.floor(n / samples_per_cluster))).cast("int")


def nearest_in(vec: Column, clusters: Column, epsilon: float = 1e-6) -> Column:
    """Nearest of an array of cluster structs; the first wins ties, none gives (inf, -1)."""
    scored = F.transform(
        clusters,
        lambda c: F.struct(
            diag_mahalanobis(vec, c.centroid, c.variance, epsilon).alias("distance"),
            c.cluster_id.alias("cluster_id"),
        ),
    )
    usable = F.filter(scored, lambda s: s.distance.isNotNull())
    none = F.struct(F.lit(float("inf")).alias("distance"), F.lit(-1).alias("cluster_id"))
    best = F.when(F.size(clusters) == 0, none).otherwise(F.array_min(usable))
    return F.when(vec.isNotNull() & clusters.isNotNull(), best)


# ---- Arrow side -----------------------------------------------------------


def as_matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a float64 matrix, and which rows are present. All must have one length."""
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().drop_null().unique()
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths.to_pylist())}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    count = int(valid.sum())
    return flat.reshape(count, -1 if count else 0), valid


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows without length become NaN."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def list_array(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def route_groups(routes: pa.Array) -> Iterator[tuple[str | None, np.ndarray]]:
    """Each route of a batch with the positions of its rows."""
    coded = routes.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for code, route in enumerate(coded.dictionary.to_pylist()):
        yield route, np.nonzero(codes == code)[0]


def scaled_distances(x: np.ndarray, centroids: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Mahalanobis distance of every row to every cluster, one cluster at a time."""
    out = np.empty((len(x), len(centroids)))
    for j in range(len(centroids)):
        diff = x - centroids[j]
        out[:, j] = np.sqrt((diff * diff / spread[j]).sum(axis=1))
    return out


def euclid_labels(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    squared = np.empty((len(x), len(centroids)))
    for j in range(len(centroids)):
        diff = x - centroids[j]
        squared[:, j] = (diff * diff).sum(axis=1)
    return squared.argmin(axis=1)


def nearest_cluster_kernel(book: Broadcast, epsilon: float):
    """Arrow UDF (route, vector) -> (distance, cluster_id) over a broadcast cluster book."""

    @F.arrow_udf("distance double, cluster_id int")
    def nearest(routes: pa.Array, vectors: pa.Array) -> pa.Array:
        x, valid = as_matrix(vectors)
        where = np.cumsum(valid) - 1
        distance = np.full(len(routes), np.nan)
        cluster = np.full(len(routes), -1, dtype=np.int32)
        for route, rows in route_groups(routes):
            entry = book.value.get(route)
            rows = rows[valid[rows]]
            if entry is None or not len(rows):
                continue
            ids, centroids, variance = entry
            d = scaled_distances(x[where[rows]], centroids, variance + epsilon)
            # NaN never wins; an infinite distance is one.
            best = np.where(np.isnan(d), np.inf, d).argmin(axis=1)
            lost = np.isnan(d[np.arange(len(rows)), best])
            best[lost] = np.isnan(d[lost]).argmin(axis=1)
            distance[rows] = d[np.arange(len(rows)), best]
            cluster[rows] = ids[best]
        missing = np.isnan(distance)
        return pa.StructArray.from_arrays(
            [pa.array(distance, mask=missing), pa.array(cluster, mask=missing)],
            names=["distance", "cluster_id"],
            mask=pa.array(missing),
        )

    return nearest


def similarity_kernel(query: list[float]):
    """Arrow UDF vector -> cosine similarity to one fixed vector."""
    q = unit_rows(np.asarray([query], dtype=np.float64))[0]

    @F.arrow_udf("double")
    def similarity(vectors: pa.Array) -> pa.Array:
        x, valid = as_matrix(vectors)
        out = np.full(len(vectors), np.nan)
        if x.size:
            out[valid] = np.round(unit_rows(x) @ q, SIMILARITY_DIGITS)
        return pa.array(out, mask=np.isnan(out))

    return similarity


MOMENTS_SCHEMA = "route string, cluster_id int, n bigint, mean array<double>, m2 array<double>"
# Partial sums held by one task before they are handed on (one per route and cluster).
MOMENTS_HELD = 20_000
# Shares of the tasks whose sums are merged first.
MERGE_SHARES = 64


def moments_kernel(label):
    """mapInArrow function: rows (route, vector) -> partial count, mean and squared spread.

    ``label(route, x)`` gives each row's cluster, or None to skip the route.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            x, valid = as_matrix(batch.column(1))
            where = np.cumsum(valid) - 1
            for route, rows in route_groups(batch.column(0)):
                rows = rows[valid[rows]]
                labels = label(route, x[where[rows]]) if len(rows) else None
                if labels is None:
                    continue
                for cluster in np.unique(labels):
                    part = x[where[rows[labels == cluster]]]
                    mean = part.mean(axis=0)
                    m2 = ((part - mean) ** 2).sum(axis=0)
                    held[route, int(cluster)] = _merge(held.get((route, int(cluster))), len(part), mean, m2)
            if len(held) > MOMENTS_HELD:
                yield _moment_batch(held)
                held = {}
        if held:
            yield _moment_batch(held)

    return run


def _moment_batch(held: dict) -> pa.RecordBatch:
    keys = list(held)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([held[k][0] for k in keys], pa.int64()),
            list_array(np.stack([held[k][1] for k in keys])),
            list_array(np.stack([held[k][2] for k in keys])),
        ],
        names=["route", "cluster_id", "n", "mean", "m2"],
    )


def _merge(old, n, mean, m2):
    if old is None:
        return n, mean, m2
    total = old[0] + n
    gap = mean - old[1]
    return total, old[1] + gap * (n / total), old[2] + m2 + gap * gap * (old[0] * n / total)


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments added up per route and cluster, row by row, whatever the number of partial sums."""
    held: dict = {}
    for batch in batches:
        means, spreads = as_matrix(batch.column(3))[0], as_matrix(batch.column(4))[0]
        for i, (route, cluster, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            held[route, cluster] = _merge(held.get((route, cluster)), n, means[i], spreads[i])
        if len(held) > MOMENTS_HELD:
            # Sorted rows may go on with the last key.
            last = held.popitem()
            yield _moment_batch(held)
            held = dict([last])
    if held:
        yield _moment_batch(held)


def merge_moments(parts: DataFrame) -> DataFrame:
    """Partial moments -> (route, cluster_id, sample_count, centroid, variance).

    Whole vectors are shuffled, first by route, cluster and a share of the
    tasks, so that no task meets the sums of all others. Means are merged
    pairwise; squares are never subtracted, so an offset costs no digits.
    """
    shared = parts.repartition("route", "cluster_id", F.spark_partition_id() % MERGE_SHARES)
    fewer = shared.mapInArrow(_merge_rows, MOMENTS_SCHEMA)
    merged = fewer.repartition("route", "cluster_id").sortWithinPartitions("route", "cluster_id")
    out = merged.mapInArrow(_merge_rows, MOMENTS_SCHEMA)
    variance = F.transform("m2", lambda v: v / F.col("n"))
    return out.select("route", "cluster_id", F.col("n").cast("int").alias("sample_count"), F.col("mean").alias("centroid"), variance.alias("variance"))


def gather_dimensions(by_dim: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, n, mean, variance) -> one row per key with arrays in dimension order."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "mean", "variance")))
    return (
        by_dim.groupBy(*keys)
        .agg(F.max("n").cast("int").alias("sample_count"), packed.alias("dims"))
        .select(
            *keys,
            "sample_count",
            F.col("dims.mean").alias("centroid"),
            F.col("dims.variance").alias("variance"),
        )
    )
