"""Counts that a running ingest leaves per micro-batch, and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.plans.quality import is_settled
from semdrift.scale import small_side

SCHEMA = "route string, received long, late long, rejected long, run string, batch_id long"


def batch_metrics(events: DataFrame, rejects: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """(route, received, late, rejected) of one micro-batch, a row per route.

    ``late`` counts rows whose event time already lies inside their route's baseline window (``windows``: route,
    window_end); no pass scores them. Rows count as they are received, repeats of an offset included. Rejected
    messages have no route; like events without one they count under null. An empty batch has no rows.
    """
    zero = F.lit(0).cast("long")
    if windows is None:
        marked = events.select("route", zero.alias("late"))
    else:
        marked = events.select("route", "event_ts").join(small_side(windows.select("route", "window_end")), "route", "left")
        marked = marked.select("route", F.coalesce(F.col("event_ts") <= F.col("window_end"), F.lit(False)).cast("long").alias("late"))
    parts = marked.select("route", F.lit(1).alias("received"), "late", zero.alias("rejected")).unionByName(
        rejects.select(F.lit(None).cast("string").alias("route"), F.lit(0).alias("received"), zero.alias("late"), F.lit(1).cast("long").alias("rejected"))
    )
    return parts.groupBy("route").agg(*[F.sum(c).cast("long").alias(c) for c in ("received", "late", "rejected")])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All batches of all runs, with ``run`` and ``batch_id``."""
    return spark.read.schema(SCHEMA).parquet(path)


def counts_until(metrics: DataFrame, run: str, batch_id: int) -> DataFrame:
    """(route, n): rows with a route that a run received up to a batch, that one included."""
    told = metrics.where((F.col("run") == run) & (F.col("batch_id") <= batch_id) & F.col("route").isNotNull() & (F.col("received") > 0))
    return told.groupBy("route").agg(F.sum("received").alias("n"))


def settled_since(metrics: DataFrame, run: str, before: int, now: int) -> DataFrame:
    """``quality.is_settled`` between two batches of a run: whether no route received a row in between."""
    return is_settled(counts_until(metrics, run, before), counts_until(metrics, run, now))
