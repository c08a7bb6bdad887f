"""Row filters over stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_STEPS = 1_000_000


def embedded_events(events: DataFrame) -> DataFrame:
    """Events that have a route and a prompt vector.

    Stored events carry a flag for it, so a query that needs no vectors does
    not read them from disk.
    """
    flag = F.col("has_prompt_embedding") if "has_prompt_embedding" in events.columns else None
    embedded = flag if flag is not None else F.col("prompt_embedding").isNotNull()
    return events.where(F.col("route").isNotNull() & embedded)


def baseline_window(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events inside their route's closed baseline window."""
    joined = events.join(windows.select("route", "window_start", "window_end"), "route")
    return joined.where(F.col("event_ts").between(F.col("window_start"), F.col("window_end"))).drop(
        "window_start", "window_end"
    )


def online_candidates(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Events strictly after their route's baseline window."""
    joined = events.join(windows.select("route", "window_end"), "route")
    return joined.where(F.col("event_ts") > F.col("window_end")).drop("window_end")


def late_rows(events: DataFrame, windows: DataFrame, since) -> DataFrame:
    """Rows stored after ``since`` whose event time is already inside the baseline window.

    No pass scores them, so their number is worth watching.
    """
    joined = events.join(windows.select("route", "window_end"), "route")
    return joined.where((F.col("kafka_ts") > since) & (F.col("event_ts") <= F.col("window_end"))).drop("window_end")


def session_filter(events: DataFrame, sessions: DataFrame | str) -> DataFrame:
    """Events of one session, or of a table of sessions."""
    if isinstance(sessions, str):
        return events.where(F.col("session_id") == sessions)
    return events.join(sessions.select("session_id").distinct(), "session_id", "left_semi")


def with_session(events: DataFrame) -> DataFrame:
    return events.where(F.col("session_id").isNotNull())


def prompt_turns(events: DataFrame) -> DataFrame:
    return events.where(F.col("frame_type") == "request_body")


def sample_streams(frames: DataFrame, rate: float) -> DataFrame:
    """Keep whole streams at ``rate``: every frame of a stream shares its fate."""
    rate = min(max(rate, 0.0), 1.0)
    slot = F.pmod(F.xxhash64("stream_id"), F.lit(SAMPLE_STEPS))
    return frames.where(slot < round(rate * SAMPLE_STEPS))
