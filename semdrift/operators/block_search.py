"""Nearest remembered vector of every turn: the exact maximum at any memory size.

Turns are searched once per distinct vector. A memory that fits the size budget
is shipped to the executors whole and each batch of vectors is one matrix
product. A larger one is cut into blocks and the vectors into groups; a task
holds as many blocks as have room and streams one group past them, so a vector
is copied once per task of its row or column and not once per block. Products
are taken in single precision; what they leave open is settled in double
(``best_rows``). Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.functions.vectors import SIMILARITY_DIGITS, as_matrix, unit_rows
from semdrift.scale import SMALL_TABLE_ROWS, cut, row_bytes

# Room for one request id in the book.
ID_BYTES = 128
# Vectors that one task searches at least, if there are so many.
TASK_ROWS = 2048
# Products of one step in single precision (4 MB), and pairs settled in double at once.
STEP_CELLS = 1_000_000
STEP_PAIRS = 65_536


@dataclass(frozen=True)
class BlockPlan:
    block_bytes: int = 64 * 1024 * 1024  # remembered vectors compared at once
    group_rows: int = 500_000  # distinct turns that meet one copy of a block; more, if there are tasks enough
    task_bytes: int = 64 * 1024 * 1024  # remembered vectors held by one task, one block at least


def distinct_memory(memory: DataFrame) -> DataFrame:
    """Remembered vectors once each, with their first request id."""
    usable = memory.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda v: v != 0))
    return usable.groupBy("embedding").agg(F.min("source_request_id").alias("source_request_id"))


def with_text(matched: DataFrame, memory: DataFrame) -> DataFrame:
    """Add the ``matched_text`` of the remembered request. Texts are joined, never broadcast as a book."""
    wanted = matched.where(F.col("matched_request_id").isNotNull()).select(
        F.col("matched_request_id").alias("source_request_id")
    )
    named = memory.select("source_request_id", "prompt_text").join(wanted.distinct(), "source_request_id", "left_semi")
    texts = named.groupBy(F.col("source_request_id").alias("matched_request_id")).agg(
        F.min("prompt_text").alias("matched_text")
    )
    return matched.join(texts, "matched_request_id", "left")


def nearest_memory(
    turns: DataFrame,
    memory: DataFrame,
    book_bytes: int = 128 * 1024 * 1024,
    blocks: BlockPlan = BlockPlan(),
) -> DataFrame:
    """Turns with ``similarity`` and ``matched_request_id`` of the closest memory.

    Without any memory, or without a prompt vector, these are NULL.
    """
    first = memory.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
    if first is None:
        return turns.withColumns(
            {
                "similarity": F.lit(None).cast("double"),
                "matched_request_id": F.lit(None).cast("string"),
            }
        )
    known = distinct_memory(memory)
    most = max(book_bytes // (row_bytes(1, first[0]) + ID_BYTES), 1)
    rows = known.limit(most + 1).toArrow()
    usable = turns.where(F.col("prompt_embedding").isNotNull())
    count = usable.agg(F.approx_count_distinct(F.xxhash64("prompt_embedding"), 0.02)).first()[0]
    asked = usable.select(*_keys(F.col("prompt_embedding")), F.col("prompt_embedding").alias("embedding"))
    asked = asked.groupBy("_k", "_l").agg(F.first("embedding").alias("embedding"))
    if rows.num_rows <= most:
        # Dealt by number: by their bytes, vectors would make few tasks.
        tasks = max(1, min(-(-count // TASK_ROWS), 4 * asked.sparkSession.sparkContext.defaultParallelism))
        found = _search_book(asked.repartition(tasks, "_k"), rows)
    else:
        found = _search_blocks(asked, count, cut(known), first[0], blocks)
    found = F.broadcast(found) if count <= SMALL_TABLE_ROWS else found
    keyed = turns.select("*", *_keys(F.col("prompt_embedding")))
    return keyed.join(found, ["_k", "_l"], "left").select(*turns.columns, "similarity", "matched_request_id")


def _keys(vector: Column) -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.when(vector.isNotNull(), F.xxhash64(vector)).alias("_k"), F.when(vector.isNotNull(), F.xxhash64(vector, F.lit(1))).alias("_l")]


# ---- whole memory on every executor ---------------------------------------


def _search_book(asked: DataFrame, rows: pa.Table) -> DataFrame:
    """``rows``: size-checked distinct memory."""
    rows = rows.sort_by("source_request_id")
    matrix = unit_rows(as_matrix(rows.column("embedding").combine_chunks())[0])
    ids = np.array(rows.column("source_request_id").to_pylist(), dtype=object)
    book = asked.sparkSession.sparkContext.broadcast((matrix, ids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, ids = book.value
        single = memory.astype(np.float32)
        for batch in batches:
            if len(batch) and len(memory):
                top, at = best_rows(unit_rows(as_matrix(batch.column(2))[0]), memory, single)
                yield _found(batch, top, ids[at])

    return asked.mapInArrow(search, _FOUND).select("_k", "_l", "similarity", F.col("request_id").alias("matched_request_id"))


_FOUND = "_k long, _l long, similarity double, request_id string"


def _found(batch: pa.RecordBatch, top: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """The first two columns of ``batch`` with what was found; rows without a similarity are left out."""
    columns = [batch.column(0), batch.column(1), pa.array(top), pa.array(ids, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["_k", "_l", "similarity", "request_id"]).filter(pa.array(~np.isnan(top)))


def best_rows(x: np.ndarray, memory: np.ndarray, single: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Highest cosine of each row of ``x`` against unit rows of ``memory``, first of equals.

    ``single`` is the memory in single precision. Its products are off by less than ``error`` on unit rows; what
    comes within that of a row's top is compared in double. Rows that stay below ``least`` may be left out (NaN).
    """
    top, at = np.full(len(x), np.nan), np.zeros(len(x), dtype=np.int64)
    error = (x.shape[1] + 8) * 2.0**-23
    step = max(1, STEP_CELLS // len(memory))
    for i in range(0, len(x), step):
        near = x[i : i + step].astype(np.float32) @ single.T
        floor = near.max(axis=1) - 2 * error
        if least is not None:
            floor = np.fmax(floor, least[i : i + step] - error)
        row, col = np.nonzero(near >= floor.astype(np.float32)[:, None] - np.float32(2.0**-22))
        if not len(row):
            continue
        cosine = np.empty(len(row))
        for j in range(0, len(row), STEP_PAIRS):
            pairs = slice(j, j + STEP_PAIRS)
            cosine[pairs] = np.einsum("ij,ij->i", x[i + row[pairs]], memory[col[pairs]])
        cosine = np.round(cosine, SIMILARITY_DIGITS)
        # Pairs come by rows, then columns.
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        highest = np.maximum.reduceat(cosine, starts)
        is_top = np.flatnonzero(cosine == np.repeat(highest, np.diff(starts, append=len(row))))
        first = is_top[np.flatnonzero(np.diff(row[is_top], prepend=-1))]
        top[i + row[first]], at[i + row[first]] = cosine[first], col[first]
    return top, at


# ---- memory in blocks -----------------------------------------------------


def _search_blocks(asked: DataFrame, count: int, known: DataFrame, dim: int, plan: BlockPlan) -> DataFrame:
    """``count``: about how many rows ``asked`` has."""
    n_blocks = max(1, -(-known.count() * (row_bytes(1, dim) + ID_BYTES) // plan.block_bytes))
    held = max(1, plan.task_bytes // plan.block_bytes)
    n_tasks = -(-n_blocks // held)
    # Every group asks for a copy of the memory, so there are no more of them than keep all cores busy.
    busy = -(-4 * asked.sparkSession.sparkContext.defaultParallelism // n_tasks)
    n_groups = max(1, min(-(-count // plan.group_rows), busy))
    none = F.lit(None)
    left = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1))).alias("task"),
        F.pmod("_k", F.lit(n_groups)).cast("int").alias("group"),
        F.lit(-1).alias("block"), "_k", "_l", F.col("embedding").cast("array<double>").alias("embedding"), none.cast("string").alias("request_id"),
    )
    block = F.pmod(F.xxhash64("embedding", F.lit(7)), F.lit(n_blocks)).cast("int")
    right = known.select(
        F.floor(block / held).cast("int").alias("task"),
        F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"),
        block.alias("block"), none.cast("long").alias("_k"), none.cast("long").alias("_l"),
        F.col("embedding").cast("array<double>").alias("embedding"), F.col("source_request_id").alias("request_id"),
    )
    order = ["task", "group", F.col("block") < 0, "block"]
    merged = left.unionByName(right).repartition("task", "group").sortWithinPartitions(*order)
    pairs = merged.mapInArrow(_match_blocks, _FOUND)
    best = pairs.groupBy("_k", "_l").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), F.col("request_id").isNull().alias("none"), "request_id")).alias("b")
    )
    return best.select("_k", "_l", (-F.col("b.s")).alias("similarity"), F.col("b.request_id").alias("matched_request_id"))


def _match_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (task, group, block), the blocks' memory first, then a group of turns (block -1)."""
    here, parts, blocks = None, {}, None
    for batch in batches:
        task, group, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        change = (np.diff(task) != 0) | (np.diff(group) != 0) | (np.diff(block) != 0)
        edges = [0, *(np.nonzero(change)[0] + 1), len(block)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if here != (task[a], group[a]):
                here, parts, blocks = (task[a], group[a]), {}, None
            rows = batch.slice(a, b - a)
            x = unit_rows(as_matrix(rows.column(5))[0])
            if block[a] >= 0:
                parts.setdefault(block[a], []).append((x, rows.column(6).to_pylist()))
                continue
            if blocks is None:
                blocks, parts = [_block(p) for p in parts.values()], {}
            top, ids = np.full(len(x), np.nan), np.full(len(x), None, dtype=object)
            for memory, single, names in blocks:
                other, at = best_rows(x, memory, single, top)
                new = names[at]
                better = (other > top) | (np.isnan(top) & ~np.isnan(other))
                for i in np.flatnonzero(other == top):
                    better[i] = (new[i] is None, new[i] or "") < (ids[i] is None, ids[i] or "")
                top[better], ids[better] = other[better], new[better]
            yield _found(rows.select([3, 4]), top, ids)


def _block(parts: list[tuple[np.ndarray, list]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix, the same in single precision, and ids; the smallest id first, so that it wins ties."""
    ids = [i for _, names in parts for i in names]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or ""))
    memory = np.concatenate([x for x, _ in parts])[order]
    return memory, memory.astype(np.float32), np.array(ids, dtype=object)[order]
