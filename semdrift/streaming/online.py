"""Scoring in micro-batches with table-backed state.

The state is a log: every batch overwrites its own folder, so a batch that
runs twice leaves one copy. Folders carry the run they belong to, so a stream
that starts anew from another checkpoint adds to the log. Readers fold the log
with the same aggregates as the batch job. A batch scores only its own turns;
earlier turns of its sessions come from the log as one row per session, route
and batch, and only the parts those sessions hash to are read. ``compact``
folds a log into a new, short one.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from semdrift.config import DetectorConfig
from semdrift.operators import rollups as R
from semdrift.operators.merge import DRIFT_COLUMNS, MEMORY_COLUMNS, best_drift_events, remember
from semdrift.plans.baseline import Baseline
from semdrift.plans.scoring import flag, new_memory, score_turns
from semdrift.streaming.offsets import read_or_none


# Parts of the session log by the hash of the session.
SESSION_PARTS = 16


@dataclass(frozen=True)
class OnlineStore:
    """Folders of the online state."""

    root: str

    @property
    def sessions(self) -> str:
        return f"{self.root}/sessions"

    @property
    def drift(self) -> str:
        return f"{self.root}/drift"

    @property
    def memory(self) -> str:
        return f"{self.root}/memory"


def folder(run: str, batch_id: int) -> str:
    """Name of a batch's folder in each log."""
    return f"batch={run}-{batch_id:012d}"


def before(df: DataFrame | None, run: str, batch_id: int) -> DataFrame | None:
    """Log rows of other runs, and of this run's earlier batches. Whole folders are left out."""
    if df is None:
        return None
    return df.where(~F.col("batch").startswith(f"{run}-") | (F.col("batch") < f"{run}-{batch_id:012d}"))


def run_name(checkpoint: str) -> str:
    """The same for every start from one checkpoint."""
    return uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex


def _part(session: Column | str) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(SESSION_PARTS)).cast("int")


def current_drift(log: DataFrame) -> DataFrame:
    """One row per session: the greatest distance so far, the oldest of equals."""
    aged = log.select(*DRIFT_COLUMNS, F.col("detected_at").alias("_age"))
    return best_drift_events(aged, "_age").select(*DRIFT_COLUMNS)


def merge_sessions(log: DataFrame) -> DataFrame:
    """Partial session rollups folded into one row per session and route."""

    def order(turn: str, rank: str):
        t = F.col(turn)
        return F.when(
            t.isNotNull(), F.struct(-t[rank], t.event_ts.isNull(), t.event_ts, t.request_id)
        )

    return log.groupBy("route", "session_id", "threshold").agg(
        F.min_by("worst", order("worst", "distance")).alias("worst"),
        F.min_by("repeat", order("repeat", "similarity")).alias("repeat"),
        F.sum("turn_count").cast("int").alias("turn_count"),
    )


def score_batch(
    batch: DataFrame,
    batch_id: int,
    baseline: Baseline,
    store: OnlineStore,
    known: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
    run: str = "run",
) -> None:
    """Score one micro-batch of stored events and log what it adds.

    ``known`` is the memory from before the stream; it may be empty.
    """
    spark, here = batch.sparkSession, folder(run, batch_id)
    learned = before(read_or_none(spark, store.memory), run, batch_id)
    memory = known if learned is None else known.unionByName(learned.select(*MEMORY_COLUMNS))
    # Cached, not checkpointed: a stream must not leave files behind.
    turns = score_turns(batch, baseline, memory, cfg).persist()
    part = (
        turns.groupBy("route", "session_id", "threshold")
        .agg(
            R.worst_turn_of().alias("worst"),
            R.best_memory_turn_of(cfg.memory_threshold).alias("repeat"),
            F.count(F.lit(1)).cast("int").alias("turn_count"),
        )
        .persist()
    )
    try:
        log = before(read_or_none(spark, store.sessions), run, batch_id)
        total = part
        if log is not None:
            # Only the log rows of this batch's sessions and of this baseline.
            key = ["route", "session_id", "threshold"]
            touched = [r[0] for r in part.select(_part("session_id")).distinct().collect()]  # at most SESSION_PARTS
            mine = log.where(F.col("part").isin(touched)).drop("batch", "part").join(part.select(*key), key, "left_semi")
            total = merge_sessions(mine.unionByName(part))
        flag(total).select(*DRIFT_COLUMNS).write.mode("overwrite").parquet(f"{store.drift}/{here}")
        added = remember(memory, new_memory(turns)).select(*MEMORY_COLUMNS)
        added.write.mode("overwrite").parquet(f"{store.memory}/{here}")
        parted = part.withColumn("part", _part("session_id")).repartition("part")
        parted.write.mode("overwrite").partitionBy("part").parquet(f"{store.sessions}/{here}")
    finally:
        part.unpersist()
        turns.unpersist()


def run_online(
    events: DataFrame,
    load_baseline,
    store: OnlineStore,
    checkpoint: str,
    known: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start scoring a stream of stored events; the baseline is loaded anew for each batch."""
    run = run_name(checkpoint)

    def step(batch: DataFrame, batch_id: int) -> None:
        score_batch(batch, batch_id, load_baseline(), store, known, cfg, run)

    # Fixed value: seconds between two scoring passes.
    trigger = trigger or {"processingTime": "30 seconds"}
    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def compact(spark: SparkSession, store: OnlineStore, target: OnlineStore) -> None:
    """Fold a stopped stream's log into one folder per table below a new root, to go on from there."""
    here = folder("compact", 0)
    sessions, drift, memory = (read_or_none(spark, p) for p in (store.sessions, store.drift, store.memory))
    if sessions is not None:
        folded = merge_sessions(sessions.drop("batch", "part")).withColumn("part", _part("session_id"))
        folded.repartition("part").write.partitionBy("part").parquet(f"{target.sessions}/{here}")
    if drift is not None:
        current_drift(drift).write.parquet(f"{target.drift}/{here}")
    if memory is not None:
        once = remember(memory.select(*MEMORY_COLUMNS).limit(0), memory.withColumn("event_ts", F.col("added_at")))
        once.select(*MEMORY_COLUMNS).write.parquet(f"{target.memory}/{here}")
