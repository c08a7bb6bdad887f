"""Stored baselines: folders with one version each, and a log of which is current."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish_baseline(routes: DataFrame, clusters: DataFrame, path: str) -> None:
    """Write both tables as a new version and make it the current one."""
    version = uuid.uuid4().hex
    clusters.write.parquet(f"{path}/versions/{version}/clusters")
    routes.write.parquet(f"{path}/versions/{version}/routes")
    line = routes.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    line.coalesce(1).write.mode("append").parquet(f"{path}/current")


def stored_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(routes, clusters) of the current version, or None if nothing was published."""
    try:
        log = spark.read.parquet(f"{path}/current")
    except AnalysisException:
        return None
    newest = log.orderBy(F.desc("published_at"), "version").first()
    if newest is None:
        return None
    at = f"{path}/versions/{newest['version']}"
    return spark.read.parquet(f"{at}/routes"), spark.read.parquet(f"{at}/clusters")


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """One row per route with its clusters, from the current version of a stored baseline."""
    found = stored_baseline(spark, path)
    if found is None:
        raise FileNotFoundError(f"no baseline was published in {path}")
    return join_clusters(*found)


def join_clusters(routes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Route rows with their clusters as an array in cluster_id order."""
    packed = clusters.groupBy("route").agg(
        F.array_sort(F.collect_list(F.struct("cluster_id", "centroid", "variance"))).alias("clusters")
    )
    empty = F.array().cast(packed.schema["clusters"].dataType)
    return routes.join(packed, "route", "left").withColumn("clusters", F.coalesce("clusters", empty))
