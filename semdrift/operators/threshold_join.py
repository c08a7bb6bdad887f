"""Pairs of vectors with at least a given cosine, by filter and verify instead of comparing all pairs.

Both sides are turned to the principal axes of the right one, so that the first coordinates hold most of a vector's
length. The right side is laid out in cells; a vector meets a cell only if the angle to its centre, less the cell's
radius, leaves room for the threshold (triangle inequality of angles). Within a cell the product of the leading
coordinates plus the product of the norms of the rest bounds the cosine (Cauchy-Schwarz); only pairs whose bound
reaches the threshold are multiplied out. Nothing is lost by either filter: bounds are loosened by ``SLACK``, far
more than rounding can move them.

Cells are gathered in parts of bounded size, and a larger cell is dealt over parts of its own. The left side is dealt in
groups; a task holds one part and streams one group past it, so a vector is copied once per part that has a cell for it,
however many cells that part has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.functions.vectors import SIMILARITY_DIGITS, as_matrix, list_array, unit_rows
from semdrift.operators.vector_index import _cells, _homes
from semdrift.scale import cut, small_side

SLACK = 1e-9
# Products of one step, pairs multiplied out at once, and angles taken at once.
STEP_CELLS = 1_000_000
STEP_PAIRS = 65_536


@dataclass(frozen=True)
class ThresholdPlan:
    max_cells: int = 1024
    sample_rows: int = 20_000  # right vectors on which cells and axes are learned; they steer speed only
    part_rows: int = 100_000  # right vectors held by one task
    group_rows: int = 500_000  # left vectors that meet one copy of a part
    lead: float = 0.6  # share of the squared length that the leading coordinates hold


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, plan: ThresholdPlan = ThresholdPlan(), best: bool = False) -> DataFrame:
    """(a, b, similarity, met, verified) for left (a, vector) and right (b, vector) with distinct ids.

    One row per pair at or above the threshold, or with ``best`` per ``a`` and task the most similar ``b`` (the
    smallest id among equals). Rows without ``b`` only carry counts: pairs met in cells and pairs multiplied out.
    Vectors without a direction pair with nothing.
    """
    spark = left.sparkSession
    schema = "a string, b string, similarity double, met long, verified long"
    usable = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    left = left.select(F.col("a").cast("string").alias("a"), F.col("vector").cast("array<double>").alias("vector")).where(usable)
    right = cut(right.select(F.col("b").cast("string").alias("b"), F.col("vector").cast("array<double>").alias("vector")).where(usable))
    count = right.count()
    if not count:
        return spark.createDataFrame([], schema)
    share = int(min(1.0, 1.2 * plan.sample_rows / count) * (1 << 40))
    drawn = right.where(F.pmod(F.xxhash64("b", F.lit(3)), F.lit(1 << 40)) < share).limit(plan.sample_rows).toArrow().sort_by("b")
    if not len(drawn):
        drawn = right.limit(1).toArrow()
    sample = unit_rows(as_matrix(drawn.column("vector").combine_chunks())[0])
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    held = np.cumsum(((sample @ axes) ** 2).mean(axis=0))
    lead = int(np.searchsorted(held, plan.lead * held[-1])) + 1
    centres = _cells(sample, min(plan.max_cells, max(1, round(len(sample) ** 0.5))), 8)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = unit_rows(as_matrix(batch.column(1))[0]) @ centres.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=["b", "vector", "cell", "angle"])

    placed = cut(right.mapInArrow(place, "b string, vector array<double>, cell int, angle double"))
    counted = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # at most max_cells rows
    radius = np.full(len(centres), -np.inf)
    radius[[r["cell"] for r in counted]] = [r["radius"] for r in counted]
    room = np.arccos(np.clip(threshold, -1, 1)) + SLACK

    sizes = {r["cell"]: r["n"] for r in counted}
    homes = _homes(sizes, plan.part_rows)
    n_parts = max(first + spread for first, spread in homes.values())
    # Which parts hold rows of a cell.
    holds = np.zeros((len(centres), n_parts), bool)
    for cell, (first, spread) in homes.items():
        holds[cell, first : first + spread] = True

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), max(1, STEP_CELLS // max(len(centres), n_parts))):
                some = batch.slice(i, max(1, STEP_CELLS // max(len(centres), n_parts)))
                row, part = np.nonzero(_near(unit_rows(as_matrix(some.column(1))[0]), centres, radius, room) @ holds)
                for j in range(0, len(row), STEP_PAIRS):
                    at = pa.array(row[j : j + STEP_PAIRS])
                    yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(part[j : j + STEP_PAIRS].astype(np.int32))], names=["a", "vector", "part"])

    # At least two tasks for each core, or a group would wait for one.
    groups = max(1, -(-left.count() // plan.group_rows), -(-2 * spark.sparkContext.defaultParallelism // n_parts))
    going = left.mapInArrow(choose, "a string, vector array<double>, part int").select(
        "part", F.pmod(F.xxhash64("a"), F.lit(groups)).cast("int").alias("group"),
        F.lit(-1).alias("cell"), F.col("a").alias("id"), "vector",
    )
    home = F.broadcast(spark.createDataFrame([(c, f, n) for c, (f, n) in homes.items()], "cell int, first int, spread int"))
    coming = placed.join(home, "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("b"), F.col("spread"))).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        "cell", F.col("b").alias("id"), "vector",
    )
    dealt = coming.unionByName(going).repartition("part", "group").sortWithinPartitions("part", "group", F.col("cell") < 0, "cell", "id")
    return dealt.mapInArrow(_verify(centres, radius, room, axes, lead, threshold, best), schema)


def _near(unit: np.ndarray, centres: np.ndarray, radius: np.ndarray, room: float) -> np.ndarray:
    """Which cells may hold a match of each row."""
    return np.arccos(np.clip(unit @ centres.T, -1, 1)) - radius <= room + 1e-7


def _verify(centres: np.ndarray, radius: np.ndarray, room: float, axes: np.ndarray, lead: int, threshold: float, best: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, cells = None, {}, None
        for batch in batches:
            part, group, cell = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            change = (np.diff(part) != 0) | (np.diff(group) != 0) | (np.diff(cell) != 0)
            edges = [0, *(np.flatnonzero(change) + 1), len(batch)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                if here != (part[start], group[start]):
                    here, parts, cells = (part[start], group[start]), {}, None
                unit = unit_rows(as_matrix(batch.column(4).slice(start, stop - start))[0])
                names = batch.column(3).slice(start, stop - start).to_pylist()
                if cell[start] >= 0:
                    parts.setdefault(int(cell[start]), []).append((names, unit))
                    continue
                if cells is None:
                    cells = {c: _cell(parts.pop(c), axes, lead) for c in list(parts)}
                names = np.array(names, object)
                for i in range(0, len(unit), 4096):
                    yield from _compare(names[i : i + 4096], unit[i : i + 4096], cells, centres, radius, room, axes, lead, threshold, best)

    return run


def _cell(parts: list, axes: np.ndarray, lead: int) -> tuple:
    whole = np.concatenate([unit for _, unit in parts])
    return np.array([i for names, _ in parts for i in names], object), whole, *_split(whole, axes, lead)


def _split(unit: np.ndarray, axes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates on the axes, and the norm of the others."""
    turned = unit @ axes
    return turned[:, :lead], np.linalg.norm(turned[:, lead:], axis=1)


def _compare(
    names: np.ndarray, unit: np.ndarray, cells: dict, centres: np.ndarray, radius: np.ndarray, room: float, axes: np.ndarray, lead: int, threshold: float, best: bool
) -> Iterator[pa.RecordBatch]:
    """The pairs of some left rows with the cells of a part, then one row of counts for each left row."""
    mine, left_over = _split(unit, axes, lead)
    met, verified, held = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64), []
    for c, (ids, whole, front, rest) in cells.items():
        near = np.flatnonzero(_near(unit, centres[c : c + 1], radius[c], room)[:, 0])
        met[near] += len(ids)
        step = max(1, STEP_CELLS // len(ids))
        for k in range(0, len(near), step):
            at = near[k : k + step]
            i, j = np.nonzero(mine[at] @ front.T + np.outer(left_over[at], rest) >= threshold - SLACK)
            i = at[i]
            verified += np.bincount(i, minlength=len(unit))
            similarity = np.empty(len(i))
            for n in range(0, len(i), STEP_PAIRS):
                pairs = slice(n, n + STEP_PAIRS)
                similarity[pairs] = np.einsum("ij,ij->i", unit[i[pairs]], whole[j[pairs]])
            similarity = np.round(similarity, SIMILARITY_DIGITS)
            good = similarity >= threshold
            i, j, similarity = i[good], j[good], similarity[good]
            if best and len(i):
                # Ids are in order, so of equals the first is the smallest.
                order = np.lexsort((j, -similarity, i))
                first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
                held.append((i[first], ids[j[first]], similarity[first]))
            elif len(i):
                yield _rows(names[i], ids[j], similarity)
    if held:
        i, b, similarity = (np.concatenate(x) for x in zip(*held, strict=True))
        order = sorted(range(len(i)), key=lambda n: (i[n], -similarity[n], b[n]))
        first = np.array(order)[np.flatnonzero(np.diff(i[order], prepend=-1))]
        yield _rows(names[i[first]], b[first], similarity[first])
    seen = np.flatnonzero(met)
    none = pa.nulls(len(seen))
    yield pa.RecordBatch.from_arrays(
        [pa.array(names[seen], pa.string()), none.cast(pa.string()), none.cast(pa.float64()), pa.array(met[seen]), pa.array(verified[seen])],
        names=["a", "b", "similarity", "met", "verified"],
    )


def _rows(a: np.ndarray, b: np.ndarray, similarity: np.ndarray) -> pa.RecordBatch:
    zero = pa.array(np.zeros(len(a), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(similarity), zero, zero], names=["a", "b", "similarity", "met", "verified"])


def matches(turns: DataFrame, memory: DataFrame, threshold: float, plan: ThresholdPlan = ThresholdPlan()) -> tuple[DataFrame, DataFrame]:
    """Turns whose nearest remembered vector reaches the threshold, with ``similarity`` and ``matched_request_id``
    as the full search gives them; and the counts (pairs, met, verified) over distinct vectors."""
    known = memory.where(F.col("embedding").isNotNull()).groupBy("embedding").agg(F.min("source_request_id").alias("b"))
    # One id may stand for several vectors, so the vectors get ids of their own that sort alike.
    known = known.select(F.col("b").alias("id"), F.concat_ws("\x01", F.col("b"), F.hex(F.xxhash64("embedding")), F.hex(F.xxhash64("embedding", F.lit(1)))).alias("b"), F.col("embedding").alias("vector"))
    asked = turns.where(F.col("prompt_embedding").isNotNull()).select("prompt_embedding").distinct()
    asked = asked.select(F.concat(F.hex(F.xxhash64("prompt_embedding")), F.hex(F.xxhash64("prompt_embedding", F.lit(1)))).alias("a"), "prompt_embedding")
    known = cut(known)
    found = cut(similar_pairs(asked.select("a", F.col("prompt_embedding").alias("vector")), known.select("b", "vector"), threshold, plan, best=True))
    hit = found.where(F.col("b").isNotNull()).groupBy("a").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "b")).alias("m"))
    named = hit.select("a", (-F.col("m.s")).alias("similarity"), F.col("m.b").alias("b")).join(known.select("b", F.col("id").alias("matched_request_id")), "b")
    vectors = asked.join(named.select("a", "similarity", "matched_request_id"), "a").drop("a")
    counts = found.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"))
    all_pairs = asked.agg(F.count(F.lit(1)).alias("x")).join(known.agg(F.count(F.lit(1)).alias("y"))).select((F.col("x") * F.col("y")).alias("pairs"))
    return turns.join(vectors, "prompt_embedding").select(*turns.columns, "similarity", "matched_request_id"), all_pairs.join(counts)


# ---- matches in the order in which vectors become known -------------------

# Known vectors that are compared at once while the earliest match is sought.
EARLY_ROWS = 1024


def known_matches(left: DataFrame, known: DataFrame, threshold: float, first: bool, plan: ThresholdPlan = ThresholdPlan()) -> DataFrame:
    """(a, similarity, since) for left (a, vector) and known (b, vector, since): matches in the order of ``since``.

    With ``first`` an ``a`` gets one row per task, its earliest match at or above the threshold. Without, it gets each
    match that is closer than all earlier ones of its task, or as close with a smaller ``since.request_id``; so the
    closest of those known before any time is among them. Pairs are compared in tasks that hold a bounded part of the
    known vectors, and never listed, so a low threshold costs time but no room. Vectors without a direction match nothing.
    """
    spark = left.sparkSession
    usable = F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    left, known = left.where(usable), known.where(usable)
    parts = max(1, -(-known.count() // plan.part_rows))
    # At least two tasks for each core, or a group would wait for one.
    groups = max(1, -(-left.count() // plan.group_rows), -(-2 * spark.sparkContext.defaultParallelism // parts))
    kind = known.schema["since"].dataType
    asked = left.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("a"), F.lit(groups)).cast("int").alias("group"),
        F.lit(1).alias("side"), F.col("a").alias("id"), "vector", F.lit(None).cast(kind).alias("since"),
    )
    held = known.select(
        F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.lit(0).alias("side"), F.col("b").alias("id"), "vector", "since",
    )
    dealt = held.unionByName(asked).repartition(parts * groups, "part", "group").sortWithinPartitions("part", "group", "side", "since", "id")
    schema = dealt.select(F.col("id").alias("a"), F.lit(0.0).alias("similarity"), "since").schema
    return dealt.mapInArrow(_meet(threshold, first), schema)


def _meet(threshold: float, first: bool):
    search = _earliest if first else _ladder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows, times, there = None, [], [], None
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            change = np.any([np.diff(k) != 0 for k in keys], axis=0)
            edges = [0, *(np.flatnonzero(change) + 1), len(batch)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                key = tuple(k[start] for k in keys[:2])
                if key != here:
                    here, rows, times, there = key, [], [], None
                unit = unit_rows(as_matrix(batch.column(4).slice(start, stop - start))[0])
                if keys[2][start] == 0:
                    rows.append(unit)
                    times.append(batch.column(5).slice(start, stop - start))
                    continue
                if not rows:
                    continue
                if there is None:
                    since = pa.concat_arrays(times)
                    names = since.field("request_id").to_pylist()
                    there = np.concatenate(rows), since, names
                step = max(1, 4_000_000 // len(there[0]))
                for i in range(0, len(unit), step):
                    at, j, similarity = search(unit[i : i + step], there[0], there[2], threshold)
                    ids = batch.column(3).take(pa.array(at + (start + i), pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(similarity, pa.float64()), there[1].take(pa.array(j, pa.int64()))], names=["a", "similarity", "since"])

    return run


def _earliest(unit: np.ndarray, known: np.ndarray, names: list, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``known``, similarity) of each row's first match."""
    left, out = np.arange(len(unit)), []
    for i in range(0, len(known), EARLY_ROWS):
        cosine = np.round(unit[left] @ known[i : i + EARLY_ROWS].T, SIMILARITY_DIGITS)
        match = cosine >= threshold
        hit = match.any(axis=1)
        at = match[hit].argmax(axis=1)
        out.append((left[hit], at + i, cosine[hit, at]))
        left = left[~hit]
        if not len(left):
            break
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _ladder(unit: np.ndarray, known: np.ndarray, names: list, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for each match that no earlier one beats."""
    cosine = unit @ known.T
    top = np.maximum.accumulate(cosine, axis=1)
    near = cosine >= threshold - SLACK
    near[:, 1:] &= cosine[:, 1:] >= top[:, :-1] - SLACK
    rows, places = np.nonzero(near)
    similarity = np.round(cosine[rows, places], SIMILARITY_DIGITS)
    kept, row, best = [], -1, None
    for k, (i, j, s) in enumerate(zip(rows.tolist(), places.tolist(), similarity.tolist(), strict=True)):
        if s < threshold:
            continue
        # A null id stands first, as in Spark.
        rung = (-s, names[j] is not None, names[j] or "")
        if i != row or rung < best:
            row, best = i, rung
            kept.append(k)
    return rows[kept], places[kept], similarity[kept]
