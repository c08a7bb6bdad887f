"""Joins between events, projections, baselines and flagged sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.scale import small_side

# Fixed value: characters of a prompt shown beside its point.
PREVIEW_CHARS = 150
# Routes whose cluster arrays may be broadcast (some 50 KB each at 768 dimensions).
CLUSTER_ROWS = 10_000


def projections_with_events(projections: DataFrame, events: DataFrame, dedupe: bool = False) -> DataFrame:
    """Projected points with session, route and prompt preview.

    A request stored more than once repeats its point unless ``dedupe``.
    """
    requests = events.where(F.col("frame_type") == "request_body").select(
        "request_id", "session_id", "route", F.left("prompt_text", F.lit(PREVIEW_CHARS)).alias("prompt_preview")
    )
    if dedupe:
        requests = requests.groupBy("request_id").agg(
            F.min(F.struct("session_id", "route", "prompt_preview")).alias("r")
        ).select("request_id", "r.*")
    return projections.select("request_id", "x", "y", "cluster_id", "cohort").join(requests, "request_id")


def join_baseline(turns: DataFrame, baseline: DataFrame) -> DataFrame:
    """Turns with their route's threshold and cluster array; routes without a baseline drop out."""
    return turns.join(small_side(baseline.select("route", "threshold", "clusters"), CLUSTER_ROWS, stored=True), "route")


def not_stored(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the target yet."""
    return df.join(target.select(*keys), keys, "left_anti")


def flag_sessions(sessions: DataFrame, drift: DataFrame) -> DataFrame:
    """Sessions with whether, by what and how strongly they were flagged."""
    marks = drift.select(
        "session_id", "flagged_by", "distance", "threshold", "worst_request_id", F.lit(True).alias("flagged")
    )
    return sessions.join(marks, "session_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
