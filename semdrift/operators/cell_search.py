"""Exact nearest vectors for a long list of queries, by cells and bounds instead of passes over all vectors.

Each distinct vector is searched and asked once. The vectors are laid out in cells; small cells share a part, a crowded
one is dealt over several. A query first meets the part of its nearest cell, beginning with that cell, and so learns how
near its k best are at least. From then on it meets a cell only if there is room for something as near: by the cell's
radius (triangle inequality of angles) and by the plane between the cell's centre and the query's nearest one, which all
vectors of a cell keep to. Parts without room are not asked at all. Vectors without any structure meet each other once.

Within a part products are taken in single precision where vectors are long; what they leave open is settled in double.
Bounds are loosened by far more than rounding can move them, so nothing is lost. Which vectors the cells are learned on
steers speed only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semdrift.functions.vectors import SIMILARITY_DIGITS, as_matrix, unit_rows
from semdrift.operators.vector_index import _cells, _homes
from semdrift.scale import cut

# Loosening of bounds: twice what similarities are rounded to, and more than products of unit rows in double are off.
SLACK = 2e-12
# Shorter vectors are multiplied in double, where that costs no more.
SINGLE_DIM = 16
# Queries that are searched together, vectors compared with them at once, and pairs settled in double at once.
BLOCK_ROWS, STEP_ROWS, STEP_PAIRS = 512, 4096, 8192
# Cells looked into before bounds are taken again, at first and at most.
FIRST_CELLS, MOST_CELLS = 4, 256


@dataclass(frozen=True)
class CellPlan:
    max_cells: int = 1024
    sample_rows: int = 20_000  # vectors on which cells are learned
    sample_bytes: int = 24 * 1024 * 1024  # as they are worked on in the driver
    part_rows: int = 100_000  # vectors held by one task
    part_bytes: int = 64 * 1024 * 1024
    group_rows: int = 100_000  # queries that meet one copy of a part


@dataclass
class _Book:
    """What every task knows: the centres of the cells that hold vectors, each cell's lowest cosine to its centre, and
    which parts hold a cell. Vectors whose length is not one by rounding are in a last cell that is always open."""

    cells: np.ndarray
    centres: np.ndarray
    low: np.ndarray
    holds: np.ndarray
    odd: int
    odd_parts: np.ndarray

    def gram(self) -> np.ndarray:
        return self.centres @ self.centres.T


def nearest(events: DataFrame, queries: DataFrame, count: int, k: int, plan: CellPlan = CellPlan()) -> DataFrame:
    """(query_id, request_id, similarity) for events (request_id, vector) and ``count`` queries (query_id, vector).

    Per query and part the k most similar of the part, the smallest ids among equals, as far as they may be among the
    k most similar of all; so the k best rows of a query id are among its rows.
    """
    spark = events.sparkSession
    float_only = all(t.schema["vector"].dataType.elementType.typeName() == "float" for t in (events, queries))
    kind = f"array<{'float' if float_only else 'double'}>"
    known = cut(_distinct_events(events, kind, k))
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", *_keys(), F.col("vector").cast(kind).alias("vector"))
    n_known = known.count()
    empty = spark.createDataFrame([], "query_id string, request_id string, similarity double")
    if not n_known:
        return empty
    dim = known.select(F.size("vector")).first()[0]
    centres = _learn(known, n_known, dim, plan)
    schema = f"_k long, _l long, names array<string>, vector {kind}, cell int, near double"
    placed = cut(known.mapInArrow(_place(centres, np.arange(len(centres)), len(centres)), schema))
    stats = placed.groupBy("cell").agg(F.min("near").alias("low"), F.count(F.lit(1)).alias("n")).collect()  # at most max_cells + 1 rows
    if not stats:
        return empty
    room = max(1, min(plan.part_rows, plan.part_bytes // (8 * max(dim, 1))))
    homes = _homes({r["cell"]: r["n"] for r in stats}, room)
    n_parts = max(first + spread for first, spread in homes.values())
    book = _book(centres, {r["cell"]: r["low"] for r in stats}, homes, n_parts)

    home = F.broadcast(spark.createDataFrame([(c, f, n) for c, (f, n) in homes.items()], "cell int, first int, spread int"))
    part = (F.col("first") + F.pmod("_k", F.col("spread"))).cast("int")
    none = F.lit(None)
    held = placed.join(home, "cell").select(part.alias("part"), "cell", "near", "_k", "_l", "names", "vector", none.cast("double").alias("least"))
    distinct = asked.groupBy("_k", "_l").agg(F.first("vector").alias("vector")).select("_k", "_l", none.cast("array<string>").alias("names"), "vector")
    at = book.cells if len(book.cells) else np.array([book.odd])
    going = distinct.mapInArrow(_place(book.centres, at, int(at[0])), schema).join(home, "cell")
    going = going.select(part.alias("part"), "cell", "near", "_k", "_l", "names", "vector", none.cast("double").alias("least"))

    shared = spark.sparkContext.broadcast(book)
    cores = spark.sparkContext.defaultParallelism
    found_schema = f"_k long, _l long, ids array<string>, similarities array<double>, least double, cell int, near double, parts array<int>, vector {kind}"

    def met(left: DataFrame, rows: int, first: bool) -> DataFrame:
        """Each query with the part it is sent to: tasks enough to keep all cores busy, each with a copy of its part."""
        groups = max(1, -(-rows // (plan.group_rows * n_parts)), -(-4 * cores // n_parts))
        right = held.select("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("side"), *held.columns[1:])
        left = left.select("part", F.pmod(F.xxhash64("_k", F.lit(3)), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("side"), *held.columns[1:])
        # Dealt by number: by their bytes, vectors would make few tasks.
        dealt = right.unionByName(left).repartition(2 * n_parts * groups, "part", "group")
        return dealt.sortWithinPartitions("part", "group", "side", "cell", F.desc("near"), "_k", "_l").mapInArrow(_meet(shared, k, first), found_schema)

    begun = cut(met(going, count, True))
    further = begun.agg(F.coalesce(F.sum(F.size("parts")), F.lit(0))).first()[0]
    out = begun
    if further:
        rest = begun.where(F.size("parts") > 0).select(F.explode("parts").alias("part"), "cell", "near", "_k", "_l", none.cast("array<string>").alias("names"), "vector", "least")
        out = begun.unionByName(met(rest, further, False))
    out = out.where(F.size("ids") > 0).select("_k", "_l", F.arrays_zip("ids", "similarities").alias("hits"))
    return asked.select("query_id", "_k", "_l").join(out, ["_k", "_l"]).select("query_id", F.explode("hits").alias("h")).select(
        "query_id", F.col("h.ids").alias("request_id"), F.col("h.similarities").alias("similarity")
    )


def _keys() -> list:
    """128 bits that stand for a vector, whatever its type."""
    v = F.col("vector").cast("array<double>")
    return [F.xxhash64(v).alias("_k"), F.xxhash64(v, F.lit(1)).alias("_l")]


def _distinct_events(events: DataFrame, kind: str, k: int) -> DataFrame:
    """(_k, _l, names, vector): vectors once each with their k smallest ids, which is all that a top-k can use."""
    keyed = events.where(F.col("vector").isNotNull()).select(F.col("request_id").cast("string").alias("request_id"), *_keys(), F.col("vector").cast(kind).alias("vector"))
    once = keyed.groupBy("_k", "_l").agg(F.first("vector").alias("vector"), F.min("request_id").alias("first"))
    if k == 1:
        return once.select("_k", "_l", F.array("first").alias("names"), "vector")
    # The rank is cut before the shuffle too, so a vector that is everywhere meets no task in full.
    order = Window.partitionBy("_k", "_l").orderBy(F.asc_nulls_last("request_id"))
    few = keyed.select("_k", "_l", "request_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    names = few.groupBy("_k", "_l").agg(F.array_sort(F.collect_list(F.struct("n", "request_id"))).alias("s"))
    return once.join(names, ["_k", "_l"]).select("_k", "_l", F.col("s.request_id").alias("names"), "vector")


def _learn(known: DataFrame, count: int, dim: int, plan: CellPlan) -> np.ndarray:
    """Centres of the cells, about the root of the vectors in number."""
    rows = max(1, min(plan.sample_rows, plan.sample_bytes // (8 * max(dim, 1))))
    share = int(min(1.0, 1.2 * rows / count) * (1 << 40))
    drawn = known.where(F.pmod(F.xxhash64("_k", F.lit(3)), F.lit(1 << 40)) < share).select("_k", "_l", "vector").limit(rows).toArrow().sort_by([("_k", "ascending"), ("_l", "ascending")])
    unit = unit_rows(as_matrix(drawn.column("vector").combine_chunks())[0]) if len(drawn) else np.empty((0, dim))
    unit = unit[_even(unit)]
    # Any direction will do where the sample has none.
    return _cells(unit, min(plan.max_cells, round(count**0.5), len(unit)), 8) if len(unit) else np.eye(1, dim)


def _even(unit: np.ndarray) -> np.ndarray:
    """Rows of length one. Others come from lengths that do not fit a double."""
    with np.errstate(invalid="ignore"):
        return np.abs(np.einsum("ij,ij->i", unit, unit) - 1) < 1e-6


def _book(centres: np.ndarray, low: dict[int, float], homes: dict[int, tuple[int, int]], n_parts: int) -> _Book:
    cells = np.array(sorted(c for c in homes if c < len(centres)), np.int64)
    holds = np.zeros((len(cells), n_parts), bool)
    for i, c in enumerate(cells):
        first, spread = homes[c]
        holds[i, first : first + spread] = True
    first, spread = homes.get(len(centres), (0, 0))
    return _Book(cells, centres[cells], np.array([low[c] for c in cells]) - SLACK, holds, len(centres), np.arange(first, first + spread))


def _place(centres: np.ndarray, cells: np.ndarray, odd: int):
    """Rows (_k, _l, names, vector) with their nearest cell of ``cells`` and the cosine to its centre. Vectors of a
    length other than one are in cell ``odd``, those without a direction left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), STEP_ROWS):
                batch = whole.slice(i, STEP_ROWS)
                x = unit_rows(as_matrix(batch.column(3))[0])
                usable = np.isfinite(x).all(axis=1)
                batch, x = batch.filter(pa.array(usable)), x[usable]
                cell, near = np.full(len(x), odd), np.full(len(x), -1.0)
                if len(x) and len(centres):
                    even = _even(x)
                    dots = x[even] @ centres.T
                    at = dots.argmax(axis=1)
                    cell[even], near[even] = cells[at], dots[np.arange(len(at)), at]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near)], names=["_k", "_l", "names", "vector", "cell", "near"])

    return run


def _open(dots: np.ndarray, star: np.ndarray, apart: np.ndarray, low: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which cells may hold a vector whose cosine to a query reaches ``least``.

    ``dots``: cosines of the queries to the cells' centres; ``star``: to their nearest centre of all; ``apart``: squared
    distances of the cells' centres from that one.
    """
    least = np.clip(least - SLACK, -1, 1)
    reach = np.outer(least, low) - np.outer(np.sqrt(1 - least**2), np.sqrt(np.maximum(1 - low**2, 0)))
    ball = (dots >= reach - SLACK) | (np.add.outer(np.arccos(least), np.arccos(np.clip(low, -1, 1))) >= np.pi)
    gap = np.maximum(star[:, None] - dots - SLACK, 0)
    return ball & (gap**2 <= (apart + 1e-12) * (2 - 2 * least)[:, None])


class _Best:
    """The k best vectors so far of each query of a block, or more that single precision can't tell apart."""

    def __init__(self, part: _Part, unit: np.ndarray, least: np.ndarray, k: int):
        self.part, self.unit, self.least, self.k = part, unit, least, k
        self.single = unit.astype(part.single.dtype)
        dim = unit.shape[1]
        self.error = (dim + 8) * 2.0**-52 + SLACK if part.single.dtype == np.float64 else (dim + 8) * 2.0**-23 + 2.0**-22
        self.query, self.place, self.value = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.new = []

    def add(self, rows: np.ndarray, places: np.ndarray) -> None:
        """Compare some queries with some vectors, none of which they have met."""
        for i in range(0, len(places), STEP_ROWS):
            some = places[i : i + STEP_ROWS]
            run = slice(some[0], some[-1] + 1) if (np.diff(some) == 1).all() else some
            near = self.single[rows] @ self.part.single[run].T
            floor = self.least[rows] - self.error
            short = np.flatnonzero(np.isneginf(floor))
            if len(short) and len(some) > self.k:
                floor[short] = np.partition(near[short], len(some) - self.k, axis=1)[:, len(some) - self.k] - 2 * self.error
            at = np.flatnonzero(near >= floor.astype(near.dtype)[:, None])
            if len(at):
                self.new.append((rows[at // len(some)], some[at % len(some)], near.ravel()[at].astype(np.float64)))
            if sum(len(n[0]) for n in self.new) > len(self.unit) * self.k:
                self.trim()

    def trim(self) -> None:
        self._gather()
        order = np.lexsort((-self.value, self.query))
        rank = self._ranks(order)
        last = order[rank == self.k - 1]
        self.least[self.query[last]] = np.maximum(self.least[self.query[last]], self.value[last] - self.error)
        kept = self.value >= self.least[self.query] - self.error
        self.query, self.place, self.value = self.query[kept], self.place[kept], self.value[kept]
        if len(self.query) > 4 * len(self.unit) * self.k:
            self.settle()

    def settle(self) -> None:
        """Exact similarities; of equals those with the smallest ids are kept."""
        self._gather()
        for i in range(0, len(self.query), STEP_PAIRS):
            some = slice(i, i + STEP_PAIRS)
            self.value[some] = np.einsum("ij,ij->i", self.unit[self.query[some]], self.part.matrix[self.place[some]])
        self.value = np.round(self.value, SIMILARITY_DIGITS)
        order = np.lexsort((self.part.first[self.place], -self.value, self.query))
        rank = self._ranks(order)
        last = order[rank == self.k - 1]
        self.least[self.query[last]] = np.maximum(self.least[self.query[last]], self.value[last])
        kept = order[rank < self.k]
        self.query, self.place, self.value = self.query[kept], self.place[kept], self.value[kept]

    def _gather(self) -> None:
        self.query, self.place, self.value = (np.concatenate(x) for x in zip((self.query, self.place, self.value), *self.new, strict=True))
        self.new = []

    def _ranks(self, order: np.ndarray) -> np.ndarray:
        """Places from 0 within each query, of rows in ``order``."""
        return _places(self.query[order], len(self.unit))


def _places(query: np.ndarray, queries: int) -> np.ndarray:
    count = np.bincount(query, minlength=queries)
    return np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)


class _Part:
    """The vectors of a part, cell after cell."""

    def __init__(self, rows: list[pa.RecordBatch], dim: int, book: _Book):
        self.matrix = np.concatenate([np.empty((0, dim)), *(unit_rows(as_matrix(r.column(7))[0]) for r in rows)])
        self.single = self.matrix.astype(np.float32) if dim >= SINGLE_DIM else self.matrix
        names = pa.concat_arrays([r.column(6) for r in rows]) if rows else pa.array([], pa.list_(pa.string()))
        self.ids = names.flatten()
        self.offsets = np.concatenate(([0], np.cumsum(names.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        # Ids by number, in their order; nulls last.
        self.order = np.empty(len(self.ids), np.int64)
        self.order[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        self.first = self.order[self.offsets[:-1]]
        cell = np.concatenate([np.empty(0, np.int64), *(r.column(3).to_numpy() for r in rows)])
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
        self.runs = {int(cell[a]): np.arange(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b}
        self.odd = self.runs.get(book.odd)
        # The cells that are here, as places in the book.
        self.here = np.flatnonzero(np.isin(book.cells, list(self.runs)))


def _meet(shared, k: int, first: bool):
    """Rows (part, group, side, cell, near, _k, _l, names, vector, least) sorted by part and group: its vectors, cell
    after cell, then queries. With ``first`` the rows found also say which other parts may hold something as near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        gram = book.gram()
        here, rows, part = None, [], None
        for batch in batches:
            batch = batch.select(["part", "group", "side", "cell", "near", "_k", "names", "vector", "_l", "least"])
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            change = np.any([np.diff(c) != 0 for c in keys], axis=0)
            edges = [0, *(np.flatnonzero(change) + 1), len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                key = keys[0][a], keys[1][a]
                if key != here:
                    here, rows, part = key, [], None
                some = batch.slice(a, b - a)
                if keys[2][a] == 0:
                    rows.append(some)
                    continue
                if part is None:
                    part, rows = _Part(rows, book.centres.shape[1], book), []
                for i in range(0, len(some), BLOCK_ROWS):
                    yield _search(some.slice(i, BLOCK_ROWS), part, int(key[0]), book, gram, k, first)

    return run


def _search(block: pa.RecordBatch, part: _Part, number: int, book: _Book, gram: np.ndarray, k: int, first: bool) -> pa.RecordBatch:
    unit = unit_rows(as_matrix(block.column(7))[0])
    n, even = len(unit), _even(unit)
    least = block.column(9).fill_null(-np.inf).to_numpy(zero_copy_only=False).copy()
    best = _Best(part, unit, least, k)
    every = np.arange(n)
    dots = unit @ book.centres.T
    nearest = dots.argmax(axis=1) if len(book.cells) else np.zeros(n, np.int64)
    star = dots[every, nearest] if len(book.cells) else np.zeros(n)

    def wanted(cells: np.ndarray) -> np.ndarray:
        """Queries by ``cells``, which are places in the book."""
        if not len(cells):
            return np.zeros((n, 0), bool)
        apart = np.maximum(2 - 2 * gram[np.ix_(nearest, cells)], 0)
        return _open(dots[:, cells], star, apart, book.low[cells], best.least) | ~even[:, None]

    if part.odd is not None:
        best.add(every, part.odd)
    met = np.zeros((n, len(book.cells)), bool)
    if first:
        home = block.column(3).to_numpy()
        for c in np.unique(home):
            rows = np.flatnonzero(home == c)
            if c in part.runs and c != book.odd:
                best.add(rows, part.runs[c])
                met[rows, np.searchsorted(book.cells, c)] = True
        best.settle()
    order = part.here[np.argsort(-dots[:, part.here].max(axis=0), kind="stable")]
    i, size = 0, FIRST_CELLS
    while i < len(order):
        cells = order[i : i + size]
        i, size = i + size, min(2 * size, MOST_CELLS)
        want = wanted(cells) & ~met[:, cells]
        full = (want.mean(axis=0) >= 0.5) & ~met[:, cells].any(axis=0)
        if full.any():
            best.add(np.flatnonzero(want[:, full].any(axis=1)), np.concatenate([part.runs[c] for c in book.cells[cells[full]].tolist()]))
        for j in np.flatnonzero(want.any(axis=0) & ~full):
            best.add(np.flatnonzero(want[:, j]), part.runs[int(book.cells[cells[j]])])
        if best.new:
            best.trim()
    best.settle()

    # A vector stands for all its ids, which are as similar.
    count = part.offsets[best.place + 1] - part.offsets[best.place]
    query, value = np.repeat(best.query, count), np.repeat(best.value, count)
    at = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(part.offsets[best.place], count)
    if len(query) > len(best.query):
        order = np.lexsort((part.order[at], -value, query))
        order = order[_places(query[order], n) < k]
        query, value, at = query[order], value[order], at[order]
    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(query, minlength=n)))).astype(np.int32))
    parts, again = np.zeros((n, 0), bool), np.zeros(n, bool)
    if first:
        parts = wanted(np.arange(len(book.cells))) @ book.holds
        parts[:, book.odd_parts] = True
        parts[:, number] = False
        again = parts.any(axis=1)
    row, other = np.nonzero(parts)
    part_ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            block.column(5), block.column(8),
            pa.ListArray.from_arrays(ends, part.ids.take(pa.array(at))), pa.ListArray.from_arrays(ends, pa.array(value)),
            pa.array(best.least, mask=np.isneginf(best.least)), block.column(3), block.column(4),
            pa.ListArray.from_arrays(part_ends, pa.array(other.astype(np.int32))),
            # Only queries that go on need their vector.
            block.column(7).take(pa.array(every, mask=~again)),
        ],
        names=["_k", "_l", "ids", "similarities", "least", "cell", "near", "parts", "vector"],
    )
