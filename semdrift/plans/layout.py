"""Neighbour-graph layout of vectors in the plane.

``neighbour_graph`` finds about k nearest neighbours by neighbour descent: points that are adjacent in some random
projections start as neighbours, then neighbours of neighbours are compared until little changes. ``fuzzy_edges``
turns similarities into membership weights. ``neighbour_layout`` starts from the main plane and moves the points in
rounds: a task holds a block of points, a weighted sample of their edges with the current places of the other ends,
and a pool of points from everywhere as negative samples, and takes some epochs of gradient steps. Places of other
blocks are those of the last round. No vector and no table of places goes to the driver.

Points of one vector share their place, so layouts are taken over distinct vectors. Results follow from the seed and
the vectors. Vectors without a direction get no place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semdrift.functions.vectors import as_matrix, unit_rows
from semdrift.scale import cut

# The curve 1 / (1 + A d^2B) of a layout with least distance 0.1.
A, B = 1.577, 0.895
# Rows compared with each other at the start, points of a task, edges of a point in a round, negative pool of a task.
START_ROWS, BLOCK_POINTS, ROUND_EDGES, POOL = 256, 2000, 40, 2000
# First step length, and negative samples for each edge that is taken.
RATE, NEGATIVES = 0.3, 5


def neighbour_graph(vectors: DataFrame, k: int = 15, projections: int = 4, rounds: int = 3, seed: int = 42) -> DataFrame:
    """(u, v, similarity): about the k nearest of each point (id long, vector) by cosine."""
    # Vectors stored in single precision are sent so, too.
    single = vectors.schema["vector"].dataType.elementType.typeName() == "float"
    rows = cut(vectors.select("id", F.col("vector").cast(f"array<{'float' if single else 'double'}>").alias("vector")))
    edges = None
    for t in range(projections):
        near = _adjacent(rows, k, seed + t)
        edges = near if edges is None else edges.unionByName(near)
    edges = cut(_best(edges, k))
    for _ in range(rounds):
        back = Window.partitionBy("v").orderBy(F.xxhash64("u", F.lit(seed)))
        reverse = edges.withColumn("n", F.row_number().over(back)).where(F.col("n") <= k).select(F.col("v").alias("centre"), F.col("u").alias("id"))
        around = edges.select(F.col("u").alias("centre"), F.col("v").alias("id")).union(reverse).union(edges.select(F.col("u"), F.col("u")).distinct()).distinct()
        # A pair below a point's k-th neighbour so far can't become one of its k best, so it is not handed on.
        least = edges.groupBy(F.col("u").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
        known = rows.join(least, "id", "left")
        held = around.join(known, "id").repartition("centre").sortWithinPartitions("centre", "id").select("centre", "id", "vector", "least")
        edges = cut(_best(edges.unionByName(held.mapInArrow(_compare_groups(k), "u long, v long, similarity double")), k))
    return edges


def _best(edges: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("u").orderBy(F.desc("similarity"), "v")
    return edges.groupBy("u", "v").agg(F.max("similarity").alias("similarity")).withColumn("n", F.row_number().over(place)).where(F.col("n") <= k).drop("n")


def _pairs(ids: np.ndarray, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of u, v, similarity): up to k nearest of each point among some."""
    similarity = np.round(unit @ unit.T, 9)
    np.fill_diagonal(similarity, -2)
    count = min(k, len(ids) - 1)
    at = np.argsort(-similarity, axis=1, kind="stable")[:, :count]
    return np.repeat(np.arange(len(ids)), count), ids[at].ravel(), np.take_along_axis(similarity, at, axis=1).ravel()


def _edges(u: np.ndarray, v: np.ndarray, similarity: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(similarity)], names=["u", "v", "similarity"])


def _adjacent(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """Neighbours among ``START_ROWS`` points that follow each other on a random line."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = unit_rows(as_matrix(batch.column(1))[0])
            line = np.random.default_rng(seed).standard_normal(unit.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(unit @ line)], names=["id", "vector", "at"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = np.empty(0, np.int64), []
        for batch in batches:
            ids = np.concatenate((ids, batch.column(0).to_numpy()))
            parts.append(unit_rows(as_matrix(batch.column(1))[0]))
            while len(ids) >= 2 * START_ROWS:
                unit = np.concatenate(parts)
                u, v, similarity = _pairs(ids[:START_ROWS], unit[:START_ROWS], k)
                yield _edges(ids[u], v, similarity)
                ids, parts = ids[START_ROWS:], [unit[START_ROWS:]]
        if len(ids) > 1:
            u, v, similarity = _pairs(ids, np.concatenate(parts), k)
            yield _edges(ids[u], v, similarity)

    kind = rows.schema["vector"].dataType.simpleString()
    lined = rows.mapInArrow(project, f"id long, vector {kind}, at double").repartitionByRange("at").sortWithinPartitions("at", "id")
    return lined.mapInArrow(compare, "u long, v long, similarity double")


def _compare_groups(k: int):
    """Rows (centre, id, vector, least) sorted by centre: the members of each group are compared with each other, pairs
    below the ``least`` of their first point left out. Groups have at most 2 k + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, parts, floors = None, [], [], []

        def done() -> list[tuple]:
            if sum(map(len, ids)) < 2:
                return []
            names = np.concatenate(ids)
            u, v, similarity = _pairs(names, np.concatenate(parts), k)
            kept = ~(similarity < np.concatenate(floors)[u])
            return [(names[u[kept]], v[kept], similarity[kept])]

        def rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            if out:
                yield _edges(*(np.concatenate(x) for x in zip(*out, strict=True)))

        for batch in batches:
            centre, member = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            unit = unit_rows(as_matrix(batch.column(2))[0])
            floor = batch.column(3).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(centre)) + 1), len(centre)]
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if centre[a] != here:
                    out += done()
                    here, ids, parts, floors = centre[a], [], [], []
                ids.append(member[a:b])
                parts.append(unit[a:b])
                floors.append(floor[a:b])
            yield from rows(out)
        yield from rows(done())

    return run


def fuzzy_edges(edges: DataFrame) -> DataFrame:
    """(u, v, weight) in both directions: memberships by distance beyond the nearest, joined as probabilities."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.column(1)
            count = others.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(count) - count
            flat = others.flatten()
            v, similarity = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("v", "similarity"))
            w = np.empty(len(v))
            # Points of as many neighbours at once.
            for n in np.unique(count):
                at = first[count == n][:, None] + np.arange(n)
                gap = 1 - similarity[at]
                gap = np.maximum(gap - gap.min(axis=1, keepdims=True), 0)
                low, high = np.full((len(gap), 1), 1e-6), np.full((len(gap), 1), 8.0)
                for _ in range(40):
                    width = (low + high) / 2
                    wider = np.exp(-gap / width).sum(axis=1, keepdims=True) < np.log2(n + 1)
                    low, high = np.where(wider, width, low), np.where(wider, high, width)
                w[at] = np.exp(-gap / high)
            u = np.repeat(batch.column(0).to_numpy(), count)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(w, pa.float64())], names=["u", "v", "w"])

    grouped = edges.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("v", "similarity"))).alias("others"))
    one_way = cut(grouped.mapInArrow(weigh, "u long, v long, w double"))
    both = one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    return both.groupBy("u", "v").agg((F.sum("w") - F.when(F.count("w") > 1, F.product("w")).otherwise(0.0)).alias("weight"))


def neighbour_layout(vectors: DataFrame, start: DataFrame, k: int = 15, rounds: int = 8, epochs: int = 60, seed: int = 42) -> DataFrame:
    """(id, x, y) for points (id long, vector), from first places ``start`` (id, x, y)."""
    edges = cut(fuzzy_edges(neighbour_graph(vectors, k, seed=seed)))
    spread = start.agg(F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("n")).first()
    wide = max(spread["sx"] or 0.0, spread["sy"] or 0.0) or 1.0
    places = cut(start.select("id", ((F.col("x") - (spread["mx"] or 0)) * (4 / wide)).alias("x"), ((F.col("y") - (spread["my"] or 0)) * (4 / wide)).alias("y")))
    blocks = max(1, -(-spread["n"] // BLOCK_POINTS))
    schema = "id long, x double, y double"
    for r in range(rounds):
        block = lambda c: F.pmod(F.xxhash64(c, F.lit(r)), F.lit(blocks)).cast("int")  # noqa: B023, E731
        # A weighted sample without replacement: the smallest of -log(uniform) / weight.
        luck = -F.log((F.pmod(F.xxhash64("u", "v", F.lit(r), F.lit(seed)), F.lit(1 << 30)) + 1) / float(1 << 30)) / F.col("weight")
        some = edges.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy(luck, "v"))).where(F.col("n") <= ROUND_EDGES)
        ends = places.select(F.col("id").alias("v"), "x", "y")
        none = F.lit(None)
        own = places.select(block("id").alias("block"), F.lit(0).alias("kind"), "id", none.cast("long").alias("other"), none.cast("double").alias("weight"), "x", "y")
        moves = some.join(ends, "v").select(block("u").alias("block"), F.lit(1).alias("kind"), F.col("u").alias("id"), F.col("v").alias("other"), "weight", "x", "y")
        # Each point is in the pools of about POOL * blocks / n tasks.
        draws = F.sequence(F.lit(0), F.lit(max(1, -(-POOL * blocks // max(spread["n"], 1))) - 1))
        drawn = places.select("id", "x", "y", F.explode(draws).alias("draw"))
        pool = drawn.select(F.pmod(F.xxhash64("id", "draw", F.lit(r), F.lit(7)), F.lit(blocks)).cast("int").alias("block"), F.lit(2).alias("kind"), "id", none.cast("long").alias("other"), none.cast("double").alias("weight"), "x", "y")
        dealt = own.unionByName(moves).unionByName(pool)
        # Dealt by number: by their bytes, blocks would make few tasks.
        tasks = min(2 * blocks, 16 * places.sparkSession.sparkContext.defaultParallelism)
        places = cut(dealt.repartition(tasks, "block").groupBy("block").applyInPandas(_epochs(epochs, r / rounds, 1 / rounds, seed + r), schema))
    return places


def _epochs(epochs: int, done: float, part: float, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        own = rows[rows["kind"] == 0].sort_values("id")
        ids = own["id"].to_numpy()
        x, y = (own[c].to_numpy(float).copy() for c in ("x", "y"))
        edges = rows[rows["kind"] == 1].sort_values(["id", "other"])
        pool = rows[rows["kind"] == 2].sort_values("id")

        def move(at: np.ndarray, pull: np.ndarray, gap_x: np.ndarray, gap_y: np.ndarray, rate: float) -> None:
            np.add.at(x, at, rate * np.clip(pull * gap_x, -4, 4))
            np.add.at(y, at, rate * np.clip(pull * gap_y, -4, 4))

        if len(ids) and len(edges):
            head = np.searchsorted(ids, edges["id"].to_numpy())
            other = edges["other"].to_numpy()
            tail = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
            inside = ids[tail] == other
            there_x, there_y, weight = (edges[c].to_numpy(float) for c in ("x", "y", "weight"))
            share = weight / weight.max()
            far, far_x, far_y = pool["id"].to_numpy(), pool["x"].to_numpy(float), pool["y"].to_numpy(float)
            near = np.minimum(np.searchsorted(ids, far), len(ids) - 1)
            mine = ids[near] == far  # points of this block are met where they are now
            for e in range(epochs):
                rate = RATE * (1.0 - (done + part * e / epochs))
                pick = np.flatnonzero(rng.random(len(head)) < share)
                at, end, own_end = head[pick], tail[pick], inside[pick]
                gap_x = x[at] - np.where(own_end, x[end], there_x[pick])
                gap_y = y[at] - np.where(own_end, y[end], there_y[pick])
                square = gap_x**2 + gap_y**2
                with np.errstate(divide="ignore", invalid="ignore"):
                    pull = np.where(square > 0, -2 * A * B * square ** (B - 1) / (1 + A * square**B), 0.0)
                move(at, pull, gap_x, gap_y, rate)
                for _ in range(NEGATIVES if len(far) else 0):
                    drawn = rng.integers(len(far), size=len(pick))
                    met, own_met = near[drawn], mine[drawn]
                    gap_x = x[at] - np.where(own_met, x[met], far_x[drawn])
                    gap_y = y[at] - np.where(own_met, y[met], far_y[drawn])
                    square = gap_x**2 + gap_y**2
                    push = np.where(square > 0, 2 * B / ((0.001 + square) * (1 + A * square**B)), 0.0)
                    move(at, push, gap_x, gap_y, rate)
        return pd.DataFrame({"id": ids, "x": x, "y": y})

    return run
