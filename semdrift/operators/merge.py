"""Upserts as plain DataFrame rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.operators.joins import not_stored

EVENT_KEY = ["kafka_topic", "kafka_partition", "kafka_offset"]

# Columns of the drift events and of the memory.
DRIFT_COLUMNS = [
    "session_id", "route", "worst_request_id", "worst_event_ts", "worst_prompt_text", "cohort",
    "distance", "threshold", "turn_count", "flagged_by", "detected_at",
]
MEMORY_COLUMNS = [
    "source_request_id", "source_session_id", "source_route", "prompt_text", "embedding", "distance", "added_at",
]


def new_events(batch: DataFrame, target: DataFrame | None) -> DataFrame:
    """Batch rows not stored yet, each topic offset once."""
    once = batch.dropDuplicates(EVENT_KEY)
    return once if target is None else not_stored(once, target, EVENT_KEY)


def upsert_baselines(old: DataFrame, new: DataFrame) -> DataFrame:
    """New route rows replace old ones; routes without a new row keep theirs."""
    return not_stored(old, new, ["route"]).unionByName(new)


def replace_clusters(old: DataFrame, new: DataFrame) -> DataFrame:
    """All cluster rows of a refitted route are replaced together."""
    return not_stored(old, new.select("route").distinct(), ["route"]).unionByName(new)


def upsert_drift_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per session; a new row wins only with a strictly greater distance."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return best_drift_events(both, "_src")


def best_drift_events(rows: DataFrame, age: str) -> DataFrame:
    """The row with the greatest distance per session; of equals the one with the lowest ``age``.

    An argmax aggregate, so each task reduces its rows before the shuffle.
    """
    fields = [c for c in rows.columns if c not in (age, "session_id")]
    order = F.struct(-F.col("distance"), F.col(age), F.col("route"))
    kept = rows.groupBy("session_id").agg(F.min_by(F.struct(*fields), order).alias("r"))
    return kept.select("session_id", "r.*").select(*[c for c in rows.columns if c != age])


def remember(old: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows to append to the memory: unknown request ids, the first turn of each."""
    fields = [c for c in hits.columns if c not in ("source_request_id", "event_ts")]
    order = F.struct(F.col("source_route"), F.col("source_session_id"), F.col("event_ts").isNull(), F.col("event_ts"))
    named = hits.where(F.col("source_request_id").isNotNull())
    first = named.groupBy("source_request_id").agg(F.min_by(F.struct(*fields), order).alias("r"))
    return not_stored(first.select("source_request_id", "r.*"), old, ["source_request_id"])


def replace_projections(projections: DataFrame, path: str) -> None:
    """Write the projection table anew."""
    projections.write.mode("overwrite").parquet(path)
