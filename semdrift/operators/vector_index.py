"""A stored index for vector search: coarse cells, one-byte codes, an exact second look.

``build`` learns cells on a bounded sample and stores every vector twice below its cell: as a code of one byte per
dimension, for the first look, and whole, for the second one. ``add`` stores further vectors in the same cells, one
folder per batch, so a batch that is added again replaces itself and nothing is rebuilt. A search reads the codes of
the cells nearest to each query, keeps the best ``refine`` x k of them, and compares only those exactly. How many
cells are looked into is measured at build time: the fewest that find ``recall`` of the neighbours in the sample.

Small cells share a part, crowded ones are dealt over parts of up to ``part_rows`` rows, and queries in groups of
``group_queries``; a task holds one group and streams one part past it, so neither a crowded cell nor a long list of
queries meets in one task, and a query is sent once to a part, however many of its cells it looks into. A search that
wants as many rows as are stored skips the first look, which could rule nothing out, and compares all exactly.

Vectors without a length (null, empty, zero, not finite) have no direction and are not stored; queries without one
find nothing. Rows that repeat a request id are found each. Ties are settled by request id. An index of no vectors
answers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semdrift.functions.vectors import SIMILARITY_DIGITS, as_matrix, doubles, list_array, unit_rows
from semdrift.scale import cut, small_side

# Parts of a stored index that a search deals out, unless they would be smaller than LEAST_PART rows.
PARTS, LEAST_PART = 64, 4096
# Stored rows compared with the queries of a task at once, and pairs sent on at once.
STEP_ROWS, STEP_PAIRS = 4096, 65_536


@dataclass(frozen=True)
class IndexConfig:
    cells: int | None = None  # default: root of the rows
    max_cells: int = 4096
    sample_rows: int = 20_000  # vectors on which cells, code ranges and probes are learned
    rounds: int = 12
    recall: float = 0.985
    refine: int = 2
    part_rows: int = 500_000
    group_queries: int = 2048


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centroids: np.ndarray
    scale: np.ndarray
    probe: int
    cfg: IndexConfig

    # ---- storing ---------------------------------------------------------

    def add(self, vectors: DataFrame, batch: str, id_col: str = "request_id", embedding: str = "prompt_embedding") -> None:
        """Store vectors under the name of their batch. The same batch stored again replaces itself."""
        rows = vectors.select(F.col(id_col).cast("string").alias("request_id"), F.col(embedding).cast("array<float>").alias("embedding"))
        centroids, scale = self.centroids, self.scale

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                ids, x, unit = _usable(part, centroids.shape[1])
                if not len(ids):
                    continue
                cell = (unit @ centroids.T).argmax(axis=1).astype(np.int32)
                code = np.clip(np.rint(unit / scale), -127, 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [ids, list_array(x.astype(np.float32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell)],
                    names=["request_id", "embedding", "code", "cell"],
                )

        if not len(centroids):
            return
        placed = cut(rows.mapInArrow(place, "request_id string, embedding array<float>, code binary, cell int").hint("rebalance", "cell"))
        for name, column in (("codes", "code"), ("vectors", "embedding")):
            placed.select("request_id", column, "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/{name}/batch={batch}")

    # ---- reading -----------------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch string, cell int").parquet(f"{self.path}/{name}")

    def probes(self, queries: DataFrame, probe: int | None = None) -> DataFrame:
        """(query_id, unit, cells): the cells that each query looks into, the nearest first."""
        centroids, count = self.centroids, min(probe or self.probe, len(self.centroids))
        asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                ids, _, unit = _usable(part, centroids.shape[1])
                if len(ids):
                    cells = np.argsort(-(unit @ centroids.T), axis=1, kind="stable")[:, :count].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids, list_array(unit), list_array(cells)], names=["query_id", "unit", "cells"])

        return asked.mapInArrow(choose, "query_id string, unit array<double>, cells array<int>")

    def _sizes(self) -> dict[int, int]:
        """Stored rows of each cell, of which there are ``max_cells`` at most."""
        codes = self._table("codes", "request_id string, code binary")
        return {r["cell"]: r["count"] for r in codes.groupBy("cell").count().collect()}

    def _dealt(self, asked: DataFrame, sizes: dict[int, int], table: str, column: str, kind: str) -> DataFrame:
        """Rows (part, group, side, cell, id, unit, cells, ``column``) in that order: the queries ``asked`` of a group,
        then what is stored of the part's cells that a query looks into."""
        room = min(self.cfg.part_rows, max(LEAST_PART, -(-sum(sizes.values()) // PARTS)))
        homes = _homes(sizes, room)
        home = F.broadcast(self.spark.createDataFrame([(c, *homes[c]) for c in sorted(homes)], "cell int, first int, spread int"))
        groups = max(1, -(-asked.select("query_id").distinct().count() // self.cfg.group_queries))
        none = F.lit(None)
        # One row for each query and part, with the cells that it looks into there.
        n = max(homes) + 1
        parts = [list(range(first, first + spread)) for first, spread in (homes.get(c, (0, 0)) for c in range(n))]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, names, lists = [], [], []
                for i, cells in enumerate(batch.column(2).to_pylist()):
                    here: dict[int, list[int]] = {}
                    for c in cells:
                        for p in parts[c] if c < n else ():
                            here.setdefault(p, []).append(c)
                    rows += [i] * len(here)
                    names += here.keys()
                    lists += here.values()
                for i in range(0, len(rows), 4096):
                    at = pa.array(rows[i : i + 4096], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(names[i : i + 4096], pa.int32()), pa.array(lists[i : i + 4096], pa.list_(pa.int32()))],
                        names=["query_id", "unit", "part", "cells"],
                    )

        left = asked.mapInArrow(send, "query_id string, unit array<double>, part int, cells array<int>").select(
            "part", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"),
            F.lit(0).alias("side"), F.lit(-1).alias("cell"), F.col("query_id").alias("id"), "unit", "cells", none.cast(kind).alias(column),
        )
        stored = self._table(table, f"request_id string, {column} {kind}").drop("batch").where("request_id is not null")
        # At most ``max_cells`` rows.
        wanted = stored.join(F.broadcast(asked.select(F.explode("cells").alias("cell")).distinct()), "cell", "left_semi").join(home, "cell")
        right = wanted.select(
            (F.col("first") + F.pmod(F.xxhash64("request_id"), F.col("spread")).cast("int")).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
            F.lit(1).alias("side"), "cell", F.col("request_id").alias("id"), none.cast("array<double>").alias("unit"), none.cast("array<int>").alias("cells"), column,
        )
        return left.unionByName(right).repartition("part", "group").sortWithinPartitions("part", "group", "side", "cell", "id")

    def candidates(self, queries: DataFrame, count: int, probe: int | None = None) -> DataFrame:
        """(query_id, request_id, cell): the ``count`` best of each query by their codes."""
        return self._by_codes(cut(self.probes(queries, probe)), self._sizes(), count)

    def _by_codes(self, asked: DataFrame, sizes: dict[int, int], count: int) -> DataFrame:
        dealt = self._dealt(asked, sizes, "codes", "code", "binary")
        found = dealt.mapInArrow(_first_look(self.scale, count), "query_id string, request_id string, cell int, near double")
        best = Window.partitionBy("query_id").orderBy(F.desc("near"), "request_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count).select("query_id", "request_id", "cell").distinct()

    def search(self, queries: DataFrame, k: int = 10, probe: int | None = None) -> DataFrame:
        """(query_id, rank, request_id, similarity): about the k nearest stored vectors of each query (query_id, vector)."""
        sizes = self._sizes() if len(self.centroids) else {}
        if not sizes:
            return self.spark.createDataFrame([], "query_id string, rank int, request_id string, similarity double")
        stored, best = sum(sizes.values()), Window.partitionBy("query_id").orderBy(F.desc("similarity"), "request_id")
        asked = cut(self.probes(queries, probe))
        vectors = queries.select(F.col("query_id").cast("string").alias("query_id"), doubles(F.col("vector")).alias("vector"))
        # Rows of a query id that comes n times count n times.
        repeats = asked.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
        if self.cfg.refine * k >= stored and repeats <= 1:
            asked = asked.join(vectors, "query_id").select("query_id", F.col("vector").alias("unit"), "cells")
            exact = self._dealt(asked, sizes, "vectors", "embedding", "array<float>").mapInArrow(_whole_look, "query_id string, request_id string, similarity double")
        else:
            near = small_side(self._by_codes(asked, sizes, self.cfg.refine * k))
            whole = self._table("vectors", "request_id string, embedding array<float>").drop("batch")
            pairs = whole.join(near, ["cell", "request_id"]).join(vectors, "query_id").select("query_id", "request_id", "embedding", "vector")
            exact = pairs.mapInArrow(_second_look, "query_id string, request_id string, similarity double")
        ranked = exact.withColumn("rank", F.row_number().over(best))
        # Where no query can have more than k rows nothing is cut, and who does not ask for ranks needs no order.
        ranked = ranked if stored * repeats <= k else ranked.where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "request_id", "similarity")

    def cost(self, queries: DataFrame, k: int = 10, probe: int | None = None) -> DataFrame:
        """(query_id, stored, codes_read, vectors_read): what a search looks at."""
        sizes = small_side(self._table("codes", "request_id string, code binary").groupBy("cell").count())
        stored = F.lit(sizes.agg(F.sum("count")).first()[0] or 0)
        read = self.probes(queries, probe).select("query_id", F.explode("cells").alias("cell")).join(sizes, "cell").groupBy("query_id").agg(F.sum("count").alias("codes_read"))
        return read.select("query_id", stored.alias("stored"), "codes_read", F.least("codes_read", F.lit(self.cfg.refine * k)).alias("vectors_read"))


def build(vectors: DataFrame, path: str, cfg: IndexConfig = IndexConfig(), id_col: str = "request_id", embedding: str = "prompt_embedding", batch: str = "first") -> VectorIndex:
    """Learn the cells, store them under ``path`` and the vectors as the first batch."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("string").alias("request_id"), F.col(embedding).cast("array<float>").alias("embedding")).where("embedding is not null")
    count = rows.count()
    share = min(1.0, 1.2 * cfg.sample_rows / max(count, 1))
    drawn = rows.where(F.pmod(F.xxhash64("request_id", F.lit(5)), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).limit(cfg.sample_rows).toArrow()
    dims = np.array([len(v) for v in drawn.column("embedding").to_pylist()], np.int64) if len(drawn) else np.empty(0, np.int64)
    dim = int(np.bincount(dims).argmax()) if len(dims) else 0
    units = [_usable(b, dim)[2] for b in drawn.sort_by("request_id").to_batches()] if dim else []
    unit = np.concatenate(units) if units else np.empty((0, dim))
    cells = min(cfg.cells or round(count**0.5), cfg.max_cells, len(unit))
    centroids = _cells(unit, cells, cfg.rounds)
    scale = np.maximum(np.abs(unit).max(axis=0) * 1.1, 1e-6) / 127 if len(unit) else np.ones(dim)
    probe = _calibrate(unit, centroids, cfg.recall) if len(unit) else 0
    model = [(i, [float(x) for x in c], [float(x) for x in scale], probe) for i, c in enumerate(centroids)]
    spark.createDataFrame(model, "cell int, centroid array<double>, scale array<double>, probe int").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    index = VectorIndex(spark, path, centroids, scale, probe, cfg)
    index.add(rows, batch, "request_id", "embedding")
    return index


def load(spark: SparkSession, path: str, cfg: IndexConfig = IndexConfig()) -> VectorIndex:
    """An index as ``build`` stored it; ``max_cells`` bounds what is read here."""
    model = spark.read.parquet(f"{path}/model").orderBy("cell").collect()
    if not model:
        return VectorIndex(spark, path, np.empty((0, 0)), np.empty(0), 0, cfg)
    return VectorIndex(spark, path, np.array([r["centroid"] for r in model]), np.array(model[0]["scale"]), model[0]["probe"], cfg)


# ---- kernels -----------------------------------------------------------------


def _usable(batch: pa.RecordBatch, dim: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, vectors and unit vectors of the rows of (id, vector) that have a direction in ``dim`` dimensions."""
    ids, vectors = batch.column(0), batch.column(1)
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    ids, vectors = ids.filter(fits), vectors.filter(fits)
    if not len(ids) or not dim:
        return ids.slice(0, 0), np.empty((0, dim)), np.empty((0, dim))
    flat = vectors.flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    fine = np.isfinite(unit).all(axis=1)
    return ids.filter(pa.array(fine)), x[fine], unit[fine]


def _cells(unit: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Spherical k-means from spread seeds."""
    if not cells:
        return np.empty((0, unit.shape[1]))
    rng = np.random.default_rng(42)
    chosen = [int(rng.integers(len(unit)))]
    gap = 1 - unit @ unit[chosen[0]]
    while len(chosen) < cells:
        weight = np.maximum(gap, 0)
        total = weight.sum()
        chosen.append(int(rng.choice(len(unit), p=weight / total)) if total > 0 else int(rng.integers(len(unit))))
        gap = np.minimum(gap, 1 - unit @ unit[chosen[-1]])
    centroids = unit[chosen].copy()
    for _ in range(rounds):
        cell = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-300), centroids)
    return centroids


def _calibrate(unit: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10, queries: int = 256) -> int:
    """Fewest cells that hold ``recall`` of the k nearest in the sample, on average."""
    asked = unit[:: max(1, len(unit) // queries)]
    nearest = np.argsort(-(asked @ unit.T), axis=1, kind="stable")[:, :k]
    cell = (unit @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    rank = np.take_along_axis(place, cell[nearest], axis=1).ravel()
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)]) + 1


def _homes(sizes: dict[int, int], part_rows: int) -> dict[int, tuple[int, int]]:
    """cell -> (first part, number of parts): small cells share a part, large ones have parts of their own."""
    homes, part, room = {}, -1, 0
    for cell, n in sorted(sizes.items()):
        if n > part_rows:
            spread = -(-n // part_rows)
            homes[cell], part, room = (part + 1, spread), part + spread, 0
        elif n > room:
            part += 1
            homes[cell], room = (part, 1), part_rows - n
        else:
            homes[cell], room = (part, 1), room - n
    return homes


def _groups(batches: Iterator[pa.RecordBatch]):
    """(key, names, unit, cells, runs) of each part and group of rows as ``_dealt`` sorts them: its queries, their unit
    vectors and cells, and an iterator of runs (cell, ids, column) of stored rows of one cell, which must be used up."""
    rows = _runs(batches)
    run = next(rows, None)
    while run is not None:
        key, names, units, cells = run[0], [], [], []
        while run is not None and run[0] == key and run[1] == 0:
            part = run[3]
            names += part.column(4).to_pylist()
            units.append(as_matrix(part.column(5))[0])
            cells += part.column(6).to_pylist()
            run = next(rows, None)

        def stored():
            nonlocal run
            while run is not None and run[0] == key:
                yield run[2], run[3].column(4), run[3].column(7)
                run = next(rows, None)

        runs = stored()
        if names:
            of: dict[int, list[int]] = {}
            for i, here in enumerate(cells):
                for c in here:
                    of.setdefault(c, []).append(i)
            yield key, names, np.concatenate(units), {c: np.array(x) for c, x in of.items()}, runs
        for _ in runs:
            pass


def _runs(batches: Iterator[pa.RecordBatch]):
    """((part, group), side, cell, rows) of neighbouring rows that have these in common."""
    for batch in batches:
        part, group, side, cell = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        change = (np.diff(part) != 0) | (np.diff(group) != 0) | (np.diff(side) != 0) | (np.diff(cell) != 0)
        edges = [0, *(np.flatnonzero(change) + 1), len(cell)]
        for a, b in zip(edges, edges[1:], strict=False):
            for i in range(a, b, STEP_ROWS):
                yield (part[a], group[a]), side[a], int(cell[a]), batch.slice(i, min(b, i + STEP_ROWS) - i)


def _first_look(scale: np.ndarray, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, names, unit, asked, runs in _groups(batches):
            weights, names = unit * scale, np.array(names, object)
            # Best products so far of each query, their ids and cells.
            held = np.empty((len(names), 0)), np.empty((len(names), 0), object), np.empty((len(names), 0), np.int32)
            for cell, ids, codes in runs:
                rows = asked.get(cell)
                if rows is not None:
                    code = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1)
                    held = _keep(held, rows, weights[rows] @ code.T.astype(np.float64), np.array(ids.to_pylist(), object), cell, count)
            near, ids, cells = held
            row, at = np.nonzero(np.isfinite(near))
            for i in range(0, len(row), STEP_PAIRS):
                r, c = row[i : i + STEP_PAIRS], at[i : i + STEP_PAIRS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[r], pa.string()), pa.array(ids[r, c], pa.string()), pa.array(cells[r, c]), pa.array(near[r, c])],
                    names=["query_id", "request_id", "cell", "near"],
                )

    return run


def _keep(held, rows: np.ndarray, near: np.ndarray, ids: np.ndarray, cell: int, count: int):
    """The best ``count`` per query of those held and the new ones of ``rows``, of equals the smallest ids; best first."""
    near = np.round(near, 9)
    order = np.argsort(-near, axis=1, kind="stable")[:, :count]
    best = np.take_along_axis(near, order, axis=1)
    old, old_ids, old_cells = held
    width = min(count, old.shape[1] + best.shape[1])
    out = np.full((len(old), width), -np.inf), np.full((len(old), width), None, object), np.full((len(old), width), -1, np.int32)
    # Queries that do not look into the cell keep what they have.
    most = min(width, old.shape[1])
    for to, now in zip(out, held, strict=True):
        to[:, :most] = now[:, :most]
    both = np.concatenate((old[rows], best), axis=1)
    both_ids = np.concatenate((old_ids[rows], ids[order]), axis=1)
    both_cells = np.concatenate((old_cells[rows], np.full(best.shape, cell, np.int32)), axis=1)
    place = np.argsort(-both, axis=1, kind="stable")
    if both.shape[1] > width:
        # Rows of one cell come by id; where the last place is shared with one of another cell, ids decide.
        ranked = np.take_along_axis(both, place, axis=1)
        for i in np.flatnonzero((ranked[:, width - 1] == ranked[:, width]) & np.isfinite(ranked[:, width])):
            place[i] = sorted(place[i], key=lambda j, i=i: (-both[i, j], both_ids[i, j] or ""))
    place = place[:, :width]
    for to, now in zip(out, (both, both_ids, both_cells), strict=True):
        to[rows] = np.take_along_axis(now, place, axis=1)
    return out


def _whole_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every query with every row of its cells."""
    for _, names, unit, asked, runs in _groups(batches):
        names, unit = pa.array(names, pa.string()), unit_rows(unit)
        for cell, ids, vectors in runs:
            rows = asked.get(cell, np.empty(0, np.int64))
            x = unit_rows(as_matrix(vectors)[0])
            step = max(1, STEP_PAIRS // len(x))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                similarity = np.round(unit[some] @ x.T, SIMILARITY_DIGITS).ravel()
                again = pa.array(np.tile(np.arange(len(x)), len(some)))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(some, len(x)))), ids.take(again), pa.array(similarity)], names=["query_id", "request_id", "similarity"])


def _second_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            x, q = unit_rows(as_matrix(batch.column(2))[0]), unit_rows(as_matrix(batch.column(3))[0])
            similarity = np.round((x * q).sum(axis=1), SIMILARITY_DIGITS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity)], names=["query_id", "request_id", "similarity"])
