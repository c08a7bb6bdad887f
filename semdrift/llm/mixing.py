"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in the order of a hash of their ids, form blocks of ``block_rows``. While all sources have
blocks left, each is due its weight of every slot; when one runs dry, the weights of the others are scaled up to 1.
A source's i-th block is released when it is due i blocks (rounded down to a slot) and wanted before it is due
i + 1 (rounded up). Slots are dealt out earliest deadline first among released blocks; as the shares add up to 1
no deadline is missed, so at any time every source is less than one block away from its share.

Spans of ``period`` slots are dealt out by tasks of their own. At the end of a span every source has its due rounded
up or down; with any such choice that fills the span all deadlines within it can be met, so spans do not depend on
each other. No weight is rounded. No document is dropped or repeated.

Sources without a weight, the null source included, get the weight of ``default_weight``. Equal rows all get places
of their own. Empty tables give empty results. Columns named ``slot`` or ``place`` in the input are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semdrift.scale import cut, small_side

BLOCK_ROWS = 16
# Slots that one task deals out.
SPAN = 1 << 18
# Rows of one source are ranked in this many independent parts, so no source is sorted in one task.
PARTS = 4096
# Rows of three longs.
BROADCAST_ROWS = 2_000_000
# Times this close to a slot count as that slot.
_EPS = 1e-6


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Blocks of each source per period, at least one each, by largest remainder. They add up to ``period``."""
    period = max(period, len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    at = 0
    while sum(out.values()) != period:
        short = sum(out.values()) < period
        s = by_rest[at % len(by_rest)] if short else by_rest[-1 - at % len(by_rest)]
        at += 1
        if short or out[s] > 1:
            out[s] += 1 if short else -1
    return out


def one_period(quota: dict[str, int]) -> list[tuple[str, int]]:
    """(source, i) for each slot of a period: the released block with the earliest deadline."""
    period = sum(quota.values())
    release: list[list[tuple[int, str, int]]] = [[] for _ in range(period)]
    for s, q in quota.items():
        for i in range(q):
            release[i * period // q].append((-(-(i + 1) * period // q), s, i))
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        for job in release[slot]:
            heapq.heappush(ready, job)
        deadline, s, i = heapq.heappop(ready)
        out.append((s, i))
    return out


class Shares:
    """How many blocks each of the sources with ``blocks`` blocks and ``weights`` is due after any number of slots.

    Source s has got min(blocks, weight * v) at virtual time v, all sources together v's slot number.
    """

    def __init__(self, blocks: np.ndarray, weights: np.ndarray) -> None:
        ends, which = np.unique(blocks / weights, return_inverse=True)
        active = weights.sum() - np.concatenate(([0.0], np.cumsum(np.bincount(which, weights))[:-1]))
        self.ends = np.concatenate(([0.0], ends))
        # Whole numbers: those of the slots at which the sources of one end are through would differ by rounding.
        self.slots = np.concatenate(([0.0], np.cumsum(np.maximum(active, 0.0) * np.diff(self.ends))))
        self.slots *= blocks.sum() / self.slots[-1]

    def due(self, slot: int, blocks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.minimum(blocks, weights * np.interp(slot, self.slots, self.ends))

    def slot(self, done: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The time at which sources of these weights are due ``done`` blocks."""
        return np.interp(done / weights, self.ends, self.slots)


def bounds(blocks: np.ndarray, weights: np.ndarray, shares: Shares, period: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first slot, blocks placed before, blocks placed after) for each span."""
    total, done = int(blocks.sum()), np.zeros(len(blocks), np.int64)
    for start in range(0, total, period):
        stop = min(start + period, total)
        due = shares.due(stop, blocks, weights)
        after = np.maximum(np.floor(due + _EPS).astype(np.int64), done)
        open_ = np.flatnonzero((np.ceil(due - _EPS) > after) & (after < blocks))
        soon = np.argsort(shares.slot(after[open_] + 1.0, weights[open_]), kind="stable")
        after[open_[soon[: max(0, stop - int(after.sum()))]]] += 1
        if after.sum() != stop:
            raise ArithmeticError(f"{after.sum()} blocks for {stop} slots")
        yield start, done, after
        done = after


def deal(start: int, source: np.ndarray, done: np.ndarray, after: np.ndarray, weights: np.ndarray, shares: Shares) -> tuple[np.ndarray, np.ndarray]:
    """(source, i) of the slots from ``start`` on: the released block with the earliest deadline."""
    count = after - done
    which = np.repeat(np.arange(len(source)), count)
    i = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + done[which]
    w = weights[which]
    release = np.maximum(np.floor(shares.slot(i.astype(float), w) + _EPS).astype(np.int64), start)
    deadline = np.minimum(np.ceil(shares.slot(i + 1.0, w) - _EPS).astype(np.int64), start + len(which))
    order = np.argsort(release, kind="stable")
    jobs = list(zip(release[order].tolist(), deadline[order].tolist(), source[which[order]].tolist(), order.tolist(), strict=True))
    ready: list[tuple[int, int, int, int]] = []
    out, at = np.empty(len(jobs), np.int64), 0
    for slot in range(len(jobs)):
        while at < len(jobs) and (jobs[at][0] <= start + slot or not ready):
            _, last, s, k = jobs[at]
            heapq.heappush(ready, (last, s, int(i[k]), k))
            at += 1
        out[slot] = heapq.heappop(ready)[3]
    return source[which[out]], i[out]


def schedule(spark: SparkSession, blocks: np.ndarray, weights: np.ndarray, period: int = SPAN) -> DataFrame:
    """(sid, __block, slot) for each block of each source number."""
    shares = Shares(blocks, weights) if len(blocks) else None
    spans = []
    for start, done, after in bounds(blocks, weights, shares, period) if len(blocks) else ():
        sid = np.flatnonzero(after > done)
        spans.append((start, *(x.tobytes() for x in (sid, done[sid], after[sid], weights[sid]))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sid, done, after = (np.frombuffer(row[c], np.int64) for c in ("sid", "done", "after"))
                s, i = deal(row["start"], sid, done, after, np.frombuffer(row["w"]), shares)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(i), pa.array(np.arange(len(s)) + row["start"])], names=["sid", "__block", "slot"])

    table = spark.createDataFrame(spans, "start long, sid binary, done binary, after binary, w binary")
    return table.repartition(max(1, len(spans))).mapInArrow(dealt, "sid long, __block long, slot long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, period: int = SPAN, default_weight: float | None = None, seed: int = 7) -> DataFrame:
    """``docs`` with ``slot`` (place of the row's block in the mix) and ``place`` (of the row itself).

    Without ``weights`` each source gets the square root of its share. Any number of sources; the
    driver holds a name and some longs for each.
    """
    spark = docs.sparkSession
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("slot", "place")]
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    marked = docs.select(*kept, F.coalesce(F.col(source).cast("string"), F.lit("\0null")).alias("__s"), key.alias("__key"))
    marked = marked.withColumn("__part", F.pmod(F.shiftright("__key", 20), F.lit(PARTS)))
    sizes = cut(marked.groupBy("__s", "__part").agg(F.count(F.lit(1)).alias("__n")))
    totals = sizes.groupBy("__s").agg(F.sum("__n").alias("n")).collect()
    names = {r["__s"]: r["n"] for r in totals}
    target = {s: (n**0.5 if weights is None else weights.get(s, default_weight if default_weight is not None else min(weights.values(), default=1.0))) for s, n in names.items()}
    if any(not w > 0 for w in target.values()):
        raise ValueError("weights must be positive")
    order = sorted(names)
    blocks = np.array([-(-names[s] // block_rows) for s in order], np.int64)
    numbers = spark.createDataFrame(list(enumerate(order)), "sid long, __s string")
    plan = schedule(spark, blocks, np.array([target[s] for s in order], float), period).join(numbers, "sid")
    plan = small_side(plan.select("__s", "__block", F.col("slot").alias("__slot")), BROADCAST_ROWS)
    offset = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = marked.withColumn("__row", F.row_number().over(Window.partitionBy("__s", "__part").orderBy("__key", F.col(id_col))) - 1)
    # At most PARTS short rows for each source.
    numbered = numbered.join(offset.select("__s", "__part", "__before"), ["__s", "__part"])
    row = F.col("__row") + F.coalesce("__before", F.lit(0))
    numbered = numbered.withColumn("__block", F.floor(row / block_rows)).withColumn("__within", row % block_rows)
    placed = numbered.join(plan, ["__s", "__block"])
    slot = F.col("__slot")
    return placed.select(*kept, slot.alias("slot"), (slot * block_rows + F.col("__within")).cast("long").alias("place"))
