"""Route clusters from spread seeds and mini-batches: a fixed number of scans, whatever the rounds.

Seeds are oversampled far from those at hand (k-means||), all routes in one scan per round, weighted by one more scan
and thinned to k per route. One scan draws bounded mini-batches of every route, which move the centres by
running means; a last scan assigns all rows. ``SCANS`` counts them; full rounds need one scan each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semdrift.config import DetectorConfig
from semdrift.functions import vectors as V
from semdrift.plans.baseline import CENTROID_DIGITS, _book, _book_moments, fetch, width
from semdrift.scale import cut, row_bytes, small_side

# Oversampling rounds, and seeds per round for each wanted cluster.
SEED_ROUNDS = 3
OVERSAMPLED = 2
MINI_BATCHES = 10
# Rows of one route in one mini-batch, on average.
BATCH_ROWS = 2048
# Scans of the sample: first seed, seeding, weights, mini-batches, last assignment.
SCANS = 1 + SEED_ROUNDS + 3
RESTARTS = 8
THIN_ROUNDS = 25


def fit_spread_clusters(
    sample: DataFrame, sizes: DataFrame, cfg: DetectorConfig = DetectorConfig(), rounds: int | None = None
) -> DataFrame:
    """(route, cluster_id, sample_count, centroid, variance), like ``baseline.fit_route_clusters``.

    ``sample``: route, request_id, prompt_embedding. ``sizes``: route, sample_count, k. ``rounds`` is the number of
    mini-batches. Rows without a vector are left out; equal rows draw alike; a route with fewer different vectors
    than k gets fewer clusters. Routes whose seeds exceed the size budget together are fitted in parts.
    """
    batches = MINI_BATCHES if rounds is None else rounds
    dim = width(sample, "prompt_embedding")
    per_route = 1 + SEED_ROUNDS * OVERSAMPLED * cfg.n_clusters
    most = max(cfg.cluster_book_bytes // row_bytes(1, dim), per_route) // per_route
    parts = 1
    while (sizes.groupBy(_part(parts)).count().agg(F.max("count")).first()[0] or 0) > most:
        parts *= 2
    part = _part(parts)
    whole = row_bytes(most * per_route, dim)
    fitted = [_fit_part(sample.where(part == i), sizes.where(part == i), cfg, batches, dim, whole) for i in range(parts)]
    out = fitted[0]
    for more in fitted[1:]:
        out = out.unionByName(more)
    return out


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("route"), F.lit(parts))


def _fit_part(sample: DataFrame, sizes: DataFrame, cfg: DetectorConfig, batches: int, dim: int, limit: int) -> DataFrame:
    spark = sample.sparkSession
    vectors = sample.select("route", "prompt_embedding")
    # Nothing at hand yet: one row per route, all with the same chance.
    routes = spark.sparkContext.broadcast({r["route"]: (None, np.empty((0, dim))) for r in sizes.select("route").collect()})
    seeds = fetch(_draw(sample, routes, 1, 0), "centroid", dim, limit)
    routes.unpersist()
    if (sizes.agg(F.max("k")).first()[0] or 1) > 1:
        seeds = _oversampled(sample, seeds, cfg, dim, limit)
        book = _book(spark, seeds, "centroid")
        weighted = _book_moments(vectors, book).select("route", "cluster_id", "sample_count", "centroid")
        thinned = weighted.join(small_side(sizes.select("route", "k")), "route").groupBy("route").applyInPandas(
            _thin, "route string, cluster_id int, centroid array<double>"
        )
        seeds = fetch(thinned, "centroid", dim, limit, CENTROID_DIGITS)
        book.unpersist()
        seeds = _by_mini_batches(sample, sizes, seeds, batches, dim, limit)
    return cut(_book_moments(vectors, _book(spark, seeds, "centroid")))


def _oversampled(sample: DataFrame, seeds: pa.Table, cfg: DetectorConfig, dim: int, limit: int) -> pa.Table:
    """Rows drawn in rounds, without replacement, by their squared distance to the seeds so far."""
    want = OVERSAMPLED * cfg.n_clusters
    for i in range(SEED_ROUNDS):
        book = _book(sample.sparkSession, seeds, "centroid")
        found = fetch(_draw(sample, book, want, 1 + i * want), "centroid", dim, limit)
        book.unpersist()
        seeds = pa.concat_tables([seeds, found])
    return seeds


def _draw(sample: DataFrame, book: Broadcast, want: int, first_id: int) -> DataFrame:
    """(route, cluster_id, centroid) of the ``want`` rows drawn per route, reduced per task and per share of the tasks."""
    draw = F.xxhash64("request_id", "prompt_embedding", F.lit(first_id)).alias("draw")
    near = sample.select("route", draw, "prompt_embedding").mapInArrow(_chooser(book, want), "route string, key double, centroid array<double>")
    near = near.withColumn("share", F.spark_partition_id() % V.MERGE_SHARES)
    for keys in (["route", "share"], ["route"]):
        order = Window.partitionBy(*keys).orderBy("key", "centroid")
        near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= want)
    return near.select("route", (F.col("r") - 1 + first_id).cast("int").alias("cluster_id"), "centroid")


def _chooser(book: Broadcast, want: int):
    """mapInArrow function: the ``want`` rows of each route in a task with the least -log(u) / squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            x, valid = V.as_matrix(batch.column(2))
            where = np.cumsum(valid) - 1
            draw = (batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(11)).astype(np.float64)
            chance = -np.log((draw + 0.5) / 2.0**53)
            for route, rows in V.route_groups(batch.column(0)):
                entry = book.value.get(route)
                rows = rows[valid[rows]]
                if entry is None or not len(rows):
                    continue
                part = x[where[rows]]
                gap = np.min([((part - c) ** 2).sum(axis=1) for c in entry[1]], axis=0) if len(entry[1]) else np.ones(len(part))
                with np.errstate(divide="ignore", invalid="ignore"):
                    key = chance[rows] / gap
                usable = np.isfinite(key)
                old = held.get(route, (np.empty(0), np.empty((0, x.shape[1]))))
                key, part = np.append(old[0], key[usable]), np.vstack([old[1], part[usable]])
                first = np.argsort(key, kind="stable")[:want]
                held[route] = key[first], part[first]
            if len(held) * want > V.MOMENTS_HELD:
                yield from _chosen(held)
                held = {}
        yield from _chosen(held)

    return run


def _chosen(held: dict) -> Iterator[pa.RecordBatch]:
    held = {route: kept for route, kept in held.items() if len(kept[0])}
    if held:
        routes = [route for route, kept in held.items() for _ in kept[0]]
        keys = np.concatenate([kept[0] for kept in held.values()])
        rows = np.vstack([kept[1] for kept in held.values()])
        yield pa.RecordBatch.from_arrays([pa.array(routes, pa.string()), pa.array(keys), V.list_array(rows)], names=["route", "key", "centroid"])


def _thin(rows: pd.DataFrame) -> pd.DataFrame:
    """k centres from the weighted seeds of one route (a bounded number): the cheapest of a few weighted k-means++ runs."""
    rows = rows.sort_values("cluster_id")
    points, weight = np.stack(rows["centroid"].to_list()), rows["sample_count"].to_numpy(np.float64)
    k = min(int(rows["k"].iloc[0]), len(points))
    best, least = points[:k], np.inf
    for seed in range(RESTARTS):
        rng = np.random.default_rng(seed)
        at = [rng.choice(len(points), p=weight / weight.sum())]
        gap = ((points - points[at[0]]) ** 2).sum(axis=1)
        while len(at) < k and (gap * weight).sum() > 0:
            at.append(rng.choice(len(points), p=gap * weight / (gap * weight).sum()))
            gap = np.minimum(gap, ((points - points[at[-1]]) ** 2).sum(axis=1))
        centres = points[at].copy()
        for _ in range(THIN_ROUNDS):
            label = V.euclid_labels(points, centres)
            for j in np.unique(label):
                centres[j] = np.average(points[label == j], axis=0, weights=weight[label == j])
        cost = (weight * ((points - centres[V.euclid_labels(points, centres)]) ** 2).sum(axis=1)).sum()
        if cost < least:
            best, least = centres, cost
    return pd.DataFrame({"route": rows["route"].iloc[0], "cluster_id": np.arange(len(best), dtype=np.int32), "centroid": list(best)})


def _by_mini_batches(sample: DataFrame, sizes: DataFrame, centres: pa.Table, batches: int, dim: int, limit: int) -> pa.Table:
    """Centres moved by bounded draws of every route; each centre's step is one over the rows it has had."""
    if not batches:
        return centres
    rate = F.least(F.lit(1.0), F.lit(float(BATCH_ROWS)) / F.col("sample_count"))
    u = [F.shiftrightunsigned(F.xxhash64("request_id", "prompt_embedding", F.lit(1000 + i)), 11) / F.lit(2.0**53) for i in range(batches)]
    drawn_in = F.filter(F.array(*[F.when(c < rate, F.lit(i)) for i, c in enumerate(u)]), lambda b: b.isNotNull())
    rated = sample.join(small_side(sizes.select("route", "sample_count")), "route")
    drawn = cut(rated.select("route", "prompt_embedding", F.explode(drawn_in).alias("batch")))
    keys = list(zip(centres["route"].to_pylist(), centres["cluster_id"].to_pylist(), strict=True))
    place = {key: i for i, key in enumerate(keys)}
    matrix, seen = V.as_matrix(centres["centroid"].combine_chunks())[0].copy(), np.zeros(len(keys))
    for i in range(batches):
        book = _book(sample.sparkSession, centres, "centroid")
        one = drawn.where(F.col("batch") == i).select("route", "prompt_embedding")
        got = fetch(_book_moments(one, book).select("route", "cluster_id", "sample_count", "centroid"), "centroid", dim, limit)
        book.unpersist()
        if not got.num_rows:
            continue
        at = [place[key] for key in zip(got["route"].to_pylist(), got["cluster_id"].to_pylist(), strict=True)]
        n = got["sample_count"].to_numpy().astype(np.float64)
        seen[at] += n
        matrix[at] += (V.as_matrix(got["centroid"].combine_chunks())[0] - matrix[at]) * (n / seen[at])[:, None]
        matrix = matrix.round(CENTROID_DIGITS)
        centres = centres.set_column(centres.column_names.index("centroid"), "centroid", V.list_array(matrix))
    return centres


def inertia(clusters: DataFrame) -> DataFrame:
    """(route, inertia): squared distances of a route's rows to the centres of their clusters."""
    part = F.col("sample_count") * F.aggregate("variance", F.lit(0.0), lambda s, v: s + v)
    return clusters.groupBy("route").agg(F.sum(part).alias("inertia"))
