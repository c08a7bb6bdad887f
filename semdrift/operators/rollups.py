"""Aggregations over events, scored turns and drift events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.functions.vectors import gather_dimensions
from semdrift.operators.filters import embedded_events

# Cohorts of the labelled data, in display order.
COHORTS = ["drift", "noise", "normal"]


def distinct_routes(events: DataFrame) -> DataFrame:
    return embedded_events(events).select("route").distinct()


def route_counts(events: DataFrame) -> DataFrame:
    return embedded_events(events).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def route_time_range(events: DataFrame) -> DataFrame:
    """First and last event time per route; routes without any drop out."""
    spans = embedded_events(events).groupBy("route").agg(
        F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts")
    )
    return spans.where(F.col("first_ts").isNotNull())


def summary_stats(events: DataFrame, drift: DataFrame, baselines: DataFrame) -> DataFrame:
    """One row of totals for the overview page.

    The three one-row results are stacked and folded, which needs no join.
    """
    none_long, none_ts = F.lit(None).cast("bigint"), F.lit(None).cast("timestamp")
    parts = [
        events.agg(F.count(F.lit(1)).alias("total_events"), F.count_distinct("session_id").alias("total_sessions"))
        .select("total_events", "total_sessions", none_long.alias("total_flagged"),
                none_ts.alias("last_baseline"), none_ts.alias("last_detection")),
        drift.agg(F.count(F.lit(1)).alias("n"), F.max("detected_at").cast("timestamp").alias("ts"))
        .select(none_long.alias("total_events"), none_long.alias("total_sessions"), F.col("n").alias("total_flagged"),
                none_ts.alias("last_baseline"), F.col("ts").alias("last_detection")),
        baselines.agg(F.max("computed_at").cast("timestamp").alias("ts"))
        .select(none_long.alias("total_events"), none_long.alias("total_sessions"), none_long.alias("total_flagged"),
                F.col("ts").alias("last_baseline"), none_ts.alias("last_detection")),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def cluster_stats(labelled: DataFrame) -> DataFrame:
    """Mean, population variance and size of each (route, cluster_id) of labelled vectors."""
    long = labelled.select("route", "cluster_id", F.posexplode("prompt_embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    by_dim = long.groupBy("route", "cluster_id", "pos").agg(
        F.count("v").alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance")
    )
    return gather_dimensions(by_dim, "route", "cluster_id")


def route_threshold(scored: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Control limit per route: mean + sigma * population stddev of the distances."""
    limit = F.avg("distance") + F.lit(float(sigma)) * F.stddev_pop("distance")
    return scored.groupBy("route").agg(limit.alias("threshold"))


def turn_fields(*extra: str) -> Column:
    return F.struct("request_id", "event_ts", "prompt_text", "cohort", *extra)


def _turn_order(rank: Column) -> Column:
    """Orders turns by ``rank``, then time with missing times last, then request id."""
    return F.struct(rank, F.col("event_ts").isNull(), F.col("event_ts"), F.col("request_id"))


def worst_turn_of(distance: str = "distance") -> Column:
    """Aggregate: the turn with the largest distance, the earliest of equals."""
    return F.min_by(turn_fields(distance), F.when(F.col(distance).isNotNull(), _turn_order(-F.col(distance))))


def best_memory_turn_of(threshold: float, similarity: str = "similarity") -> Column:
    """Aggregate: the turn most similar to remembered drift, if one reaches the threshold."""
    hit = F.col(similarity) >= threshold
    return F.min_by(turn_fields(similarity), F.when(hit, _turn_order(-F.col(similarity))))


def worst_turn(scored: DataFrame) -> DataFrame:
    """The worst turn of every session on every route."""
    out = scored.groupBy("route", "session_id").agg(worst_turn_of().alias("t"))
    return out.where(F.col("t").isNotNull()).select("route", "session_id", "t.*")


def best_memory_turn(scored: DataFrame, threshold: float = 0.9) -> DataFrame:
    out = scored.groupBy("route", "session_id").agg(best_memory_turn_of(threshold).alias("t"))
    return out.where(F.col("t").isNotNull()).select("route", "session_id", "t.*")


def session_rollup(scored: DataFrame) -> DataFrame:
    """Largest distance and number of online turns per session and route."""
    return scored.groupBy("route", "session_id").agg(
        F.max("distance").alias("worst_distance"), F.count(F.lit(1)).cast("int").alias("turn_count")
    )


def session_route(turns: DataFrame) -> DataFrame:
    """The first route seen in each session; it picks the baseline for the session's drill-down."""
    order = F.struct(F.col("event_ts").isNull(), F.col("event_ts"), F.col("request_id"), F.col("frame_type"))
    first = turns.groupBy("session_id").agg(F.min_by(F.struct("route"), order).alias("f"))
    return first.select("session_id", F.col("f.route").alias("route"))


def cluster_composition(projections: DataFrame, cohorts: list[str] = COHORTS) -> DataFrame:
    """Cluster by cohort counts; rows without a cohort are left out."""
    table = projections.where(F.col("cohort").isNotNull()).groupBy("cluster_id").pivot("cohort", cohorts).count()
    return table.fillna(0, cohorts)


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """Clusters by size with their cohort breakdown, rows without a cohort included."""
    cells = labelled.groupBy("cluster_id", "cohort").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("cluster_id").agg(F.sum("n").alias("cluster_size"))
    return cells.join(totals, "cluster_id").orderBy(
        F.desc("cluster_size"), "cluster_id", F.desc("n"), F.col("cohort").asc_nulls_last()
    )


def flagged_by_cohort(drift: DataFrame) -> DataFrame:
    return drift.groupBy("cohort").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cohort")


def cohort_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


def evaluate_detector(events: DataFrame, drift: DataFrame) -> DataFrame:
    """Flagged and total sessions per cohort: recall for drift, false positives for normal."""
    sessions = events.where(F.col("session_id").isNotNull()).select("session_id", "cohort").distinct()
    flagged = drift.select("session_id", F.lit(1).alias("hit"))
    per_cohort = sessions.join(flagged, "session_id", "left").groupBy("cohort").agg(
        F.count(F.lit(1)).alias("sessions"), F.count("hit").alias("flagged")
    )
    return per_cohort.withColumn("flag_rate", F.col("flagged") / F.col("sessions"))
