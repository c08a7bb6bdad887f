"""Baseline job: what normal traffic looks like on each route, for all routes at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semdrift.config import DetectorConfig
from semdrift.functions import vectors as V
from semdrift.functions.scalars import window_end
from semdrift.operators.filters import baseline_window, embedded_events
from semdrift.operators.merge import replace_clusters, upsert_baselines
from semdrift.operators.rollups import cluster_stats, route_threshold, route_time_range
from semdrift.scale import cut, row_bytes, small_side
from semdrift.sources.baselines import publish_baseline, stored_baseline

# Centroids are rounded in each round, so that the order of additions never decides a label.
CENTROID_DIGITS = 12


@dataclass
class Baseline:
    """``routes``: route, sample_count, n_clusters, threshold, window_start, window_end, computed_at.

    ``clusters``: route, cluster_id, sample_count, centroid, variance.
    """

    routes: DataFrame
    clusters: DataFrame

    def write(self, path: str) -> None:
        """Publish a new version of the stored baseline as a whole.

        Routes that were not fitted this time keep their stored rows. Both tables go to a folder of their own;
        then one row names it, so a reader, or a crash in between, never sees tables of two versions.
        """
        old = stored_baseline(self.routes.sparkSession, path)
        routes, clusters = self.routes, self.clusters
        if old is not None:
            routes, clusters = upsert_baselines(old[0], routes), replace_clusters(old[1], clusters)
        publish_baseline(routes, clusters, path)


def route_windows(events: DataFrame, fraction: float) -> DataFrame:
    """The settled part of each route's observed time range."""
    start, end = F.col("first_ts"), F.col("last_ts")
    return route_time_range(events).select(
        "route", start.alias("window_start"), window_end(start, end, fraction).cast(_type_of(events)).alias("window_end")
    )


def _type_of(events: DataFrame):
    return events.schema["event_ts"].dataType


def compute_baselines(
    events: DataFrame, cfg: DetectorConfig = DetectorConfig(), rounds: int | None = None, fit: Callable[..., DataFrame] | None = None
) -> Baseline:
    """Fit clusters and thresholds for every route with enough samples.

    ``fit`` is ``fit_route_clusters`` (full rounds) or ``spread.fit_spread_clusters`` (spread seeds, mini-batches).
    """
    windows = small_side(route_windows(events, cfg.baseline_fraction))
    columns = ["route", "request_id", "event_ts", "prompt_embedding"]
    sample = baseline_window(embedded_events(events).select(*columns), windows).drop("event_ts")
    if cfg.cache_sample:
        sample = sample.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = cut(
        sample.groupBy("route")
        .agg(F.count(F.lit(1)).cast("int").alias("sample_count"))
        .where(F.col("sample_count") >= cfg.min_samples)
    )
    sizes = sizes.withColumn("k", V.effective_k(F.col("sample_count"), cfg.n_clusters, cfg.samples_per_cluster))
    try:
        clusters = (fit or fit_route_clusters)(sample, sizes, cfg, rounds)
        scored = score_nearest(sample, clusters, cfg)
        limits = cut(route_threshold(scored, cfg.sigma))
    finally:
        if cfg.cache_sample:
            sample.unpersist()
    counted = clusters.groupBy("route").agg(F.count(F.lit(1)).cast("int").alias("n_clusters"))
    routes = (
        sizes.drop("k")
        .join(counted, "route")
        .join(limits, "route")
        .join(windows, "route")
        .select(
            "route", "sample_count", "n_clusters", "threshold", "window_start", "window_end",
            F.current_timestamp().alias("computed_at"),
        )
    )
    return Baseline(routes, clusters)


# ---- k-means per route ----------------------------------------------------


def initial_centroids(sample: DataFrame, sizes: DataFrame, max_k: int) -> DataFrame:
    """The k rows of each route whose request ids hash lowest.

    Only keys are ranked, and each task keeps its own k; vectors are fetched
    for the winners afterwards.
    """
    order = Window.partitionBy("route").orderBy(F.md5("request_id"), "request_id")
    ranked = sample.select("route", "request_id").withColumn("rank", F.row_number().over(order))
    chosen = ranked.where(F.col("rank") <= max_k).join(sizes.select("route", "k"), "route")
    chosen = small_side(chosen.where(F.col("rank") <= F.col("k")).drop("k"))
    seeds = sample.join(chosen, ["route", "request_id"])
    return seeds.groupBy("route", (F.col("rank") - 1).alias("cluster_id")).agg(
        F.min("prompt_embedding").cast("array<double>").alias("centroid")
    )


def fit_route_clusters(
    sample: DataFrame, sizes: DataFrame, cfg: DetectorConfig = DetectorConfig(), rounds: int | None = None
) -> DataFrame:
    """Lloyd's algorithm on every route of ``sizes`` together.

    ``sample``: route, request_id, prompt_embedding. ``sizes``: route, k.
    Every round is one scan of the sample that yields partial sums per task.
    Centroids within the size budget travel as a broadcast book; there are at
    most k per route, so they never outgrow it later.
    """
    rounds = cfg.lloyd_rounds if rounds is None else rounds
    if (sizes.agg(F.max("k")).first()[0] or 1) == 1:
        rounds = 0
    seeds = initial_centroids(sample, sizes, cfg.n_clusters)
    dim = width(sample, "prompt_embedding")
    rows = fetch(seeds, "centroid", dim, cfg.cluster_book_bytes)
    vectors = sample.select("route", "prompt_embedding")
    if rows is None:
        return _fit_by_join(vectors, cut(seeds), rounds)
    for _ in range(rounds):
        # No more rows than before, so they fit again.
        book = _book(vectors.sparkSession, rows, "centroid")
        moments = _book_moments(vectors, book).select("route", "cluster_id", "centroid")
        moved = fetch(moments, "centroid", dim, cfg.cluster_book_bytes, CENTROID_DIGITS)
        book.unpersist()
        same, rows = _equal(rows, moved), moved
        if same:
            break
    return cut(_book_moments(vectors, _book(vectors.sparkSession, rows, "centroid")))


def _book_moments(vectors: DataFrame, book: Broadcast) -> DataFrame:
    """Label the sample by its nearest centroid and aggregate each label."""

    def label(route: str, x: np.ndarray):
        entry = book.value.get(route)
        return None if entry is None else entry[0][V.euclid_labels(x, entry[1])]

    return V.merge_moments(vectors.mapInArrow(V.moments_kernel(label), V.MOMENTS_SCHEMA))


def _fit_by_join(vectors: DataFrame, centroids: DataFrame, rounds: int) -> DataFrame:
    """The same with centroids joined by route, for any number of routes."""
    for _ in range(rounds):
        rounded = F.transform("centroid", lambda v: F.round(v, CENTROID_DIGITS)).alias("centroid")
        moved = cut(_join_moments(vectors, centroids).select("route", "cluster_id", rounded))
        if moved.exceptAll(centroids).isEmpty():
            break
        centroids = moved
    return cut(_join_moments(vectors, centroids))


def _join_moments(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    packed = centroids.groupBy("route").agg(
        F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("centroids")
    )
    x = V.doubles(F.col("prompt_embedding"))
    gaps = F.transform(
        "centroids",
        lambda c: F.struct(
            F.aggregate(F.zip_with(x, c.centroid, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v),
            c.cluster_id.alias("cluster_id"),
        ),
    )
    return cluster_stats(vectors.join(packed, "route").withColumn("cluster_id", F.array_min(gaps).cluster_id))


def width(df: DataFrame, vector: str) -> int:
    """Length of the vectors of a table; 1 if it has none."""
    first = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return first[0] if first else 1


def fetch(df: DataFrame, vector: str, dim: int, limit: int, digits: int | None = None) -> pa.Table | None:
    """Rows of a cluster table on the driver, or None when their vectors exceed ``limit`` bytes.

    The number of rows asked for is bounded before anything is fetched.
    """
    most = max(limit // row_bytes(1, dim), 1)
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return None
    rows = rows.sort_by([("route", "ascending"), ("cluster_id", "ascending")])
    if digits is not None and rows.num_rows:
        at = rows.column_names.index(vector)
        flat = V.as_matrix(rows.column(vector).combine_chunks())[0].round(digits)
        rows = rows.set_column(at, vector, V.list_array(flat))
    return rows


def _equal(a: pa.Table, b: pa.Table) -> bool:
    return a.select(["route", "cluster_id", "centroid"]).equals(b.select(["route", "cluster_id", "centroid"]))


def _book(spark: SparkSession, rows: pa.Table, *names: str) -> Broadcast:
    """Broadcast of route -> (cluster ids, matrix per name) from sorted, size-checked rows."""
    ids = rows.column("cluster_id").to_numpy().astype(np.int32)
    matrices = [V.as_matrix(rows.column(n).combine_chunks())[0] for n in names]
    routes = rows.column("route").combine_chunks()
    book = {route: (ids[at], *(m[at] for m in matrices)) for route, at in V.route_groups(routes)}
    return spark.sparkContext.broadcast(book)


# ---- distance to the baseline ---------------------------------------------


def score_nearest(turns: DataFrame, clusters: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Add ``distance`` and ``cluster_id`` of the nearest cluster of the turn's route.

    Rows without a vector, or on routes without clusters, get NULL; so do rows
    whose distances are all NaN. An infinite distance counts. A cluster
    table within the size budget goes to every executor; a larger one is
    joined by route.
    """
    both = clusters.select("route", "cluster_id", "centroid", "variance")
    rows = fetch(both, "centroid", 2 * width(clusters, "centroid"), cfg.cluster_book_bytes)
    if rows is not None:
        book = _book(turns.sparkSession, rows, "centroid", "variance")
        nearest = V.nearest_cluster_kernel(book, cfg.epsilon)
        found = turns.withColumn("_n", nearest("route", "prompt_embedding"))
        return found.select(
            *turns.columns, F.col("_n.distance").alias("distance"), F.col("_n.cluster_id").alias("cluster_id")
        )
    packed = clusters.groupBy("route").agg(
        F.array_sort(F.collect_list(F.struct("cluster_id", "centroid", "variance"))).alias("clusters")
    )
    joined = turns.join(packed, "route", "left")
    nearest = V.nearest_in(F.col("prompt_embedding"), F.col("clusters"), cfg.epsilon)
    return joined.withColumn("_n", nearest).select(
        *turns.columns, F.col("_n.distance").alias("distance"), F.col("_n.cluster_id").alias("cluster_id")
    )
