"""Running positions and totals inside groups of any size, top-k and session lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semdrift.scale import cut

# Groups up to this many rows are numbered in one task each.
GROUP_ROWS = 5_000_000


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: Column,
    name: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add the sum of ``value`` over this and all earlier rows of the group.

    ``order`` must leave no ties. Groups are counted first. If one exceeds
    ``group_rows``, rows are range-partitioned by group and order, so a big
    group spreads over many tasks, and each task's start value is added.
    """
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= group_rows:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*up_to_here)))

    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    placed = cut(spread.withColumn("_task", F.spark_partition_id()).withColumn("_value", value))
    totals = placed.groupBy(*keys, "_task").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # Ranges are contiguous, so each task continues at most one group: the
    # start values are no more than the tasks.
    starts = totals.withColumn("_start", F.sum("_total").over(before)).where(F.col("_start").isNotNull())
    starts = F.broadcast(starts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_task").alias("_at"), "_start"))
    same = F.col("_task") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    local = Window.partitionBy(*keys, "_task").orderBy(*order).rowsBetween(*up_to_here)
    return (
        placed.withColumn(name, F.sum("_value").over(local))
        .join(starts, same, "left")
        .withColumn(name, F.col(name) + F.coalesce("_start", F.lit(0)))
        .select(*df.columns, name)
    )


def position(df: DataFrame, keys: list[str], order: list[Column], name: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add the 1-based position of each row in its group."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), name, group_rows)


def turn_index(turns: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Number the prompt turns of each session from 0 in event-time order."""
    order = [F.col("event_ts").asc_nulls_last(), F.col("request_id").asc_nulls_last()]
    return position(turns, ["session_id"], order, "turn_index", group_rows).withColumn(
        "turn_index", F.col("turn_index") - 1
    )


def frame_seq(frames: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Number the frames of each stream from 1 by time and event id."""
    order = [F.col("timestamp").asc_nulls_last(), F.col("event_id").asc_nulls_last()]
    return position(frames, ["stream_id"], order, "frame_seq", group_rows)


def recent(events: DataFrame, n: int = 5000) -> DataFrame:
    """The n most recently ingested rows."""
    return events.orderBy(F.col("kafka_ts").desc_nulls_last(), F.col("kafka_offset").desc_nulls_last()).limit(n)


def top_drift_events(drift: DataFrame, n: int = 20) -> DataFrame:
    return drift.orderBy(F.col("distance").desc_nulls_last(), "session_id").limit(n)


def list_sessions(events: DataFrame, limit: int = 2000) -> DataFrame:
    """Sorted distinct session ids, the first ``limit`` of them."""
    ids = events.where(F.col("session_id").isNotNull()).select("session_id").distinct()
    return ids.orderBy("session_id").limit(limit)


def default_session(drift: DataFrame, sessions: DataFrame) -> DataFrame:
    """The flagged session with the highest distance, else the first session."""
    flagged = top_drift_events(drift, 1).select("session_id", F.lit(0).alias("_rank"))
    first = sessions.orderBy("session_id").limit(1).select("session_id", F.lit(1).alias("_rank"))
    return flagged.unionByName(first).orderBy("_rank").limit(1).drop("_rank")


def session_options(sessions: DataFrame, selected: DataFrame) -> DataFrame:
    """Listed sessions together with the selected ones, once each and sorted."""
    return sessions.select("session_id").union(selected.select("session_id")).distinct().orderBy("session_id")
