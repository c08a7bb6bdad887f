"""Nearest prompts to given vectors, exact and approximate, and memory hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semdrift.functions.encode import Encoder, embed_text
from semdrift.functions.vectors import SIMILARITY_DIGITS, as_matrix, doubles, similarity_kernel, unit_rows
from semdrift.operators import cell_search
from semdrift.operators.threshold_join import ThresholdPlan, matches
from semdrift.scale import cut

# Query vectors that are compared in one pass over the events; more go by cells.
QUERIES_PER_PASS = 2048
# Events compared with all queries of a pass at once, and pairs settled in double at once.
STEP_ROWS = 2048
STEP_PAIRS = 32_768


def top_k(events: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k events nearest to one vector by cosine, with their ``similarity``."""
    scored = events.withColumn("similarity", similarity_kernel(query)("prompt_embedding"))
    return scored.where(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), "request_id").limit(k)


def nearest_prompts(events: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """Search result listing for one query vector."""
    columns = ["request_id", "kafka_ts", "route", "session_id", "cohort"]
    embedded = events.where(F.col("prompt_embedding").isNotNull()).select(*columns, "prompt_text", "prompt_embedding")
    found = top_k(embedded, query, k)
    return found.select(*columns, F.left("prompt_text", F.lit(200)).alias("prompt_preview"), "similarity")


def nearest_prompts_batch(
    events: DataFrame, queries: DataFrame, k: int = 10, per_pass: int = QUERIES_PER_PASS
) -> DataFrame:
    """(query_id, rank, request_id, similarity): the k nearest events of every query.

    Up to ``per_pass`` queries go to every task, which keeps its own k best per
    query, so at most queries x k rows per task are shuffled. More queries meet
    the events by cells (``cell_search``), whose vectors are then made once.
    """
    asked = cut(queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").alias("v")))
    count = asked.count()
    turns = events.where(F.col("prompt_embedding").isNotNull()).select("request_id", "prompt_embedding")
    if count > per_pass:
        stored = cut(turns).select("request_id", F.col("prompt_embedding").alias("vector"))
        out = cell_search.nearest(stored, asked.select("query_id", F.col("v").alias("vector")), count, k)
    else:
        rows = asked.toArrow().sort_by("query_id")
        out = turns.mapInArrow(_best_per_query(turns.sparkSession, rows, k), "query_id string, request_id string, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "request_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "request_id", "similarity")


def search_texts(
    events: DataFrame, queries: DataFrame, k: int = 10, encoder: Encoder | None = None, per_pass: int = QUERIES_PER_PASS
) -> DataFrame:
    """The batch search for texts (query_id, text), embedded like stored prompts."""
    asked = embed_text(queries.select("query_id", "text"), "text", "vector", "query", encoder)
    return nearest_prompts_batch(events, asked.where(F.col("vector").isNotNull()), k, per_pass)


def _best_per_query(spark: SparkSession, rows: pa.Table, k: int):
    present = rows.filter(rows.column("v").is_valid()) if len(rows) else rows
    matrix = unit_rows(as_matrix(present.column("v").combine_chunks())[0]) if len(present) else np.empty((0, 0))
    asked = spark.sparkContext.broadcast((present.column("query_id").to_pylist(), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = asked.value
        if not names:
            return
        single = matrix.astype(np.float32)
        # Query, similarity and id of the k best so far of each query, and the k-th similarity of those that have k.
        held = np.empty(0, np.int64), np.empty(0), np.empty(0, dtype=object)
        least = np.full(len(names), -np.inf)
        for batch in batches:
            for i in range(0, len(batch), STEP_ROWS):
                some = batch.slice(i, STEP_ROWS)
                x = unit_rows(as_matrix(some.column(1))[0])
                query, row = _candidates(matrix, single, x, least, k)
                ids = np.array(some.column(0).to_pylist(), dtype=object)[row]
                held, least = _keep_best(held, (query, _cosines(matrix, x, query, row), ids), len(names), k)
        query, similarity, ids = held
        if len(query):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(names, dtype=object)[query], pa.string()), pa.array(ids, pa.string()), pa.array(similarity)],
                names=["query_id", "request_id", "similarity"],
            )

    return run


def _candidates(matrix: np.ndarray, single: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all rows of ``x`` that may be among the k best of a query whose k-th best so far is ``least``.

    Products in single precision are off by less than ``error`` on unit rows, so none that counts is left out.
    """
    near = single @ x.astype(np.float32).T
    near[np.isnan(near)] = -np.inf
    error = (x.shape[1] + 8) * 2.0**-23
    floor = least - error
    short = np.flatnonzero(np.isneginf(least))
    if len(short) and len(x) > k:
        floor[short] = np.partition(near[short], len(x) - k, axis=1)[:, len(x) - k] - 2 * error
    return np.nonzero((near >= (floor - 2.0**-22).astype(np.float32)[:, None]) & (near > -np.inf))


def _cosines(matrix: np.ndarray, x: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.empty(len(query))
    for i in range(0, len(query), STEP_PAIRS):
        pairs = slice(i, i + STEP_PAIRS)
        out[pairs] = np.einsum("ij,ij->i", matrix[query[pairs]], x[row[pairs]])
    return np.round(out, SIMILARITY_DIGITS)


def _keep_best(held: tuple, new: tuple, queries: int, k: int) -> tuple[tuple, np.ndarray]:
    """The k best of each query of two lists, of equals the smallest ids; and each query's k-th similarity, if it has k."""
    query, similarity, ids = (np.concatenate(x) for x in zip(held, new, strict=True))
    # A null id stands last.
    place = np.empty(len(ids), np.int64)
    place[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or ""))] = np.arange(len(ids))
    order = np.lexsort((place, -similarity, query))
    count = np.bincount(query, minlength=queries)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    kept = order[rank < k]
    least = np.full(queries, -np.inf)
    last = order[rank == k - 1]
    least[query[last]] = similarity[last]
    return (query[kept], similarity[kept], ids[kept]), least


def memory_hits(turns: DataFrame, memory: DataFrame, threshold: float = 0.9, plan: ThresholdPlan = ThresholdPlan()) -> DataFrame:
    """Turns that repeat remembered drift, on whatever route it was seen, by a threshold join."""
    return matches(turns, memory, threshold, plan)[0]


def approx_nearest(
    events: DataFrame,
    queries: DataFrame,
    k: int = 10,
    max_angle_cosine: float = 0.0,
    bucket_length: float = 0.5,
    tables: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Approximate form of the batch search by locality-sensitive hashing.

    On unit vectors the squared Euclidean distance is 2 - 2 cosine. Copies of
    a vector would share every bucket, so each distinct vector is hashed once
    and brings its k smallest request ids, which is all a top-k can use.
    """
    distinct = events.where(F.col("prompt_embedding").isNotNull()).select("prompt_embedding", "request_id")
    copies = Window.partitionBy("prompt_embedding").orderBy("request_id")
    kept = distinct.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k)
    vectors = kept.groupBy("prompt_embedding").agg(F.collect_list("request_id").alias("request_ids"))

    def unit(col):
        v = doubles(F.col(col))
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return array_to_vector(F.transform(v, lambda x: x / F.when(length > 0, length)))

    usable = F.exists("prompt_embedding", lambda x: x != 0)
    base = vectors.where(usable).select("request_ids", unit("prompt_embedding").alias("unit"))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), unit("vector").alias("unit"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="buckets", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    model = lsh.fit(base)
    radius = float(np.sqrt(2 - 2 * max_angle_cosine))
    pairs = model.approxSimilarityJoin(asked, base, radius, distCol="d")
    hits = pairs.select(
        F.col("datasetA.query_id").alias("query_id"),
        F.explode("datasetB.request_ids").alias("request_id"),
        F.round(1 - F.col("d") * F.col("d") / 2, SIMILARITY_DIGITS).alias("similarity"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "request_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found, per query."""
    found = approximate.select("query_id", "request_id", F.lit(1).alias("hit"))
    return (
        exact.join(found, ["query_id", "request_id"], "left")
        .groupBy("query_id")
        .agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    )
