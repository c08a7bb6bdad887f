"""Session drill-down and timeline reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.config import DetectorConfig
from semdrift.functions import scalars as S
from semdrift.operators.filters import prompt_turns
from semdrift.operators.ordering import GROUP_ROWS, turn_index
from semdrift.operators.rollups import session_route
from semdrift.plans.baseline import Baseline, score_nearest
from semdrift.scale import small_side


def session_trend(
    events: DataFrame, baseline: Baseline, cfg: DetectorConfig = DetectorConfig(), group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Distance of every prompt turn of every session, numbered in time order.

    The first route of a session picks the baseline for all its turns. Sessions
    whose route has no baseline have no trend.
    """
    timed = events.where(F.col("session_id").isNotNull())
    turns = prompt_turns(timed).select("session_id", "request_id", "event_ts", "prompt_text", "prompt_embedding")
    routed = turns.join(session_route(timed), "session_id")
    routed = routed.join(small_side(baseline.routes.select("route", "threshold"), stored=True), "route")
    scored = score_nearest(routed, baseline.clusters, cfg)
    return turn_index(scored, group_rows).select(
        "session_id", "turn_index", "request_id", "event_ts", "route", "distance", "threshold",
        S.preview(F.col("prompt_text"), 80).alias("prompt_preview"),
    )


def session_transcript(events: DataFrame) -> DataFrame:
    """User and assistant messages of the given sessions in event-time order."""
    user = (F.col("frame_type") == "request_body") & S.has_text(F.col("prompt_text"))
    assistant = (F.col("frame_type") == "response_body") & S.has_text(F.col("completion_text"))
    role = F.when(user, "user").when(assistant, "assistant")
    lines = events.withColumn("role", role).where(F.col("role").isNotNull())
    return lines.select(
        "session_id", "event_ts", "request_id", "role",
        F.when(F.col("role") == "user", F.col("prompt_text")).otherwise(F.col("completion_text")).alias("content"),
    ).orderBy("session_id", F.col("event_ts").asc_nulls_last(), "request_id")


def anomaly_timeline(drift: DataFrame) -> DataFrame:
    """Flagged sessions in time order, each with its own threshold."""
    return drift.select(
        "session_id", "cohort", "route", "distance", "threshold", "turn_count", "flagged_by",
        "worst_event_ts", "worst_prompt_text",
    ).orderBy(F.col("worst_event_ts").asc_nulls_last(), "session_id")
