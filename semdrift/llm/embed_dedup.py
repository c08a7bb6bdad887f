"""Near-duplicate vectors by collision counting on many one-dimensional projections.

Unit vectors are projected on ``m`` random directions. Each direction is a sorted line, and only its two tails,
beyond ``tail`` standard deviations, are kept: a vector far out has few neighbours there, while a vector close
to it lies far out too. A query's window on a line reaches ``WIDTH`` to either side of it; pairs within are
collisions, counted over all lines, and pairs with at least ``COUNT`` of them are verified in double precision.

For any one pair with cosine c its two projections are normal with correlation c, whatever the data look like.
So the chance of a collision is known, and ``m`` is set such that a pair at the threshold collides less than
``COUNT`` times with a chance of at most ``1 - RECALL``. The tail moves out as the table grows, so that a line
keeps about ``LINE`` vectors: pairs that collide by chance grow in proportion to the rows and lines.

Equal vectors form a class and are joined once. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and vectors of different length never link. Rows with a null id are dropped.
Rows that share an id are one vector, the smallest. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.llm.components import components
from semdrift.scale import cut

WIDTH = 1.0
COUNT = 2
RECALL = 0.999
LINE = 40
MAX_TAIL = 4.5
_STEP = 1024


def _density(x: np.ndarray) -> np.ndarray:
    return np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def tail_start(n: int) -> float:
    """The tail beyond which about ``LINE`` of ``n`` standard normal values lie."""
    x = np.linspace(0.5, MAX_TAIL, 401)
    above = np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in x])
    return float(x[np.argmin(np.abs(np.log(above * max(n, 1) / LINE)))])


def collision_chance(cosine: float, tail: float, width: float = WIDTH) -> float:
    """Chance that two projections with this correlation both exceed ``tail`` and differ by at most ``width``."""
    x = np.linspace(tail, tail + 8, 2000)
    spread = math.sqrt(max(1 - cosine * cosine, 1e-12))
    upto = lambda v: np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in (v - cosine * x) / spread])
    inner = np.maximum(upto(x + width) - upto(np.maximum(x - width, tail)), 0)
    return float(np.trapezoid(_density(x) * inner, x))


def lines_needed(cosine: float, tail: float, count: int = COUNT, recall: float = RECALL) -> int:
    """Number of directions, each with two tails, for ``recall`` at ``cosine``."""
    mean = float(count)
    while sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(count)) > 1 - recall:
        mean += 0.05
    return math.ceil(mean / (2 * collision_chance(cosine, tail)))


def _directions(first: int, n: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, first]).standard_normal((n, dim)).astype(np.float32)


def _lines(vectors: DataFrame, tail: float, m: int, seed: int) -> DataFrame:
    """(line, cell, id, x): places of the vectors in the tails. Negative tails are lines of their own."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch["unit"]])
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                ids = batch["id"].to_numpy()[rows]
                unit = np.array(batch["unit"].take(pa.array(rows)).to_pylist(), np.float32)
                for first in range(0, m, _STEP):
                    n = min(_STEP, m - first)
                    x = unit @ _directions(first, n, int(dim), seed).T
                    i, j = np.nonzero(np.abs(x) >= tail)
                    if len(i):
                        v = x[i, j]
                        line = (int(dim) << 40) + 2 * (first + j) + (v < 0)
                        place = np.abs(v).astype(np.float64)
                        cell = np.floor((place - tail) / WIDTH).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(line, pa.int64()), pa.array(cell), pa.array(ids[i]), pa.array(place)], names=["line", "cell", "id", "x"])

    return vectors.select("id", "unit").mapInArrow(project, "line long, cell int, id long, x double")


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.concatenate([np.empty(0)] + [x.values.to_numpy() for x in batch[c] if len(x)]) for c in ("u", "v"))
            ends = np.cumsum([len(x) for x in batch["u"]])
            dots = np.diff(np.concatenate(([0.0], np.concatenate(([0.0], np.cumsum(u * v)))[ends]))) if len(ends) else np.empty(0)
            same = len(set(np.diff(np.concatenate(([0], ends))))) == 1
            if same:  # the usual case, without running sums
                dots = np.einsum("ij,ij->i", u.reshape(len(ends), -1), v.reshape(len(ends), -1))
            out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(dots)], names=["a", "b", "cosine"])
            yield out.filter(pa.array(dots >= threshold))

    return pairs.mapInArrow(verify, "a long, b long, cosine double")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each distinct id of ``vectors``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    sum2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    norm = F.sqrt(sum2)
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.array_max(F.transform("v", F.abs))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    rows = rows.withColumn("v", F.when(usable & (largest > 0), F.transform("v", lambda x: x / largest)))
    rows = cut(rows.withColumn("unit", F.when(F.col("v").isNotNull(), F.transform("v", lambda x: x / norm))).select("id", "unit"))
    classes = rows.where("unit is not null").groupBy("unit").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes)
    n = classes.count()
    tail = tail_start(n)
    m = lines_needed(threshold, tail)
    heads = classes.select(F.col("head").alias("id"), "unit")
    # A task's projections are its rows times m; many small tasks keep them short.
    placed = cut(_lines(heads.repartition(max(8, n // 2048), "id"), tail, m, seed))
    query = placed.alias("q")
    # A window reaches into the next cell at most.
    around = placed.select("line", F.explode(F.array("cell", F.col("cell") - 1)).alias("cell"), "id", "x", F.col("cell").alias("own")).alias("c")
    window = (F.col("q.line") == F.col("c.line")) & (F.col("q.cell") == F.col("c.cell")) & (F.abs(F.col("q.x") - F.col("c.x")) <= WIDTH)
    once = (F.col("c.own") > F.col("q.cell")) | ((F.col("c.own") == F.col("q.cell")) & (F.col("q.id") < F.col("c.id")))
    met = query.join(around, window & once).select(F.least("q.id", "c.id").alias("a"), F.greatest("q.id", "c.id").alias("b"))
    often = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= COUNT).select("a", "b")
    both = often.join(heads.select(F.col("id").alias("a"), F.col("unit").alias("u")), "a").join(heads.select(F.col("id").alias("b"), F.col("unit").alias("v")), "b")
    links = cut(_verify(both, threshold))
    sizes = classes.select(F.col("head"), "copies")
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = ends.join(sizes, ends["b"] == sizes["head"]).groupBy("a").agg(F.sum("copies").alias("others"))
    found = components(links.select("a", "b"))
    class_rows = classes.join(degree, classes["head"] == degree["a"], "left").join(found, classes["head"] == found["id"], "left")
    class_rows = class_rows.select("unit", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "head").alias("component_id"))
    out = rows.join(class_rows, "unit", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
