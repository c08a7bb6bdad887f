"""Topic clusters and two-dimensional projections of prompts."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.functions.vectors import doubles
from semdrift.operators.ordering import recent
from semdrift.plans.layout import neighbour_layout
from semdrift.scale import cut


def topic_clusters(prompts: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """Prompts with the k-means cluster of their vector as ``cluster_id``."""
    vectors = prompts.withColumn("_v", array_to_vector(doubles(F.col("prompt_embedding"))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster_id").fit(vectors)
    return model.transform(vectors).drop("_v")


def project_2d(prompts: DataFrame, k: int = 8, seed: int = 42, graph: bool = False) -> DataFrame:
    """Projection rows (request_id, x, y, cluster_id, cohort) from the two main components, or with ``graph`` from
    a neighbour-graph layout that starts there."""
    labelled = topic_clusters(prompts, k, seed).withColumn("_v", array_to_vector(doubles(F.col("prompt_embedding"))))
    at = vector_to_array("_p")
    plane = PCA(k=2, inputCol="_v", outputCol="_p").fit(labelled).transform(labelled).withColumns({"x": at[0], "y": at[1]})
    if graph:
        point = F.xxhash64("prompt_embedding")
        points = cut(plane.select(point.alias("id"), F.col("prompt_embedding").alias("vector"), "x", "y").where(F.exists("vector", lambda v: v != 0)).dropDuplicates(["id"]))
        places = neighbour_layout(points.select("id", "vector"), points.select("id", "x", "y"), seed=seed)
        plane = plane.drop("x", "y").withColumn("id", point).join(places, "id", "left")
    return plane.select("request_id", "x", "y", "cluster_id", "cohort", F.current_timestamp().alias("computed_at"))


def projections(events: DataFrame, n: int | None = None, k: int = 8, graph: bool = False) -> DataFrame:
    """Projection of all prompts with a vector, or of the ``n`` most recent ones."""
    embedded = events.where(F.col("prompt_embedding").isNotNull())
    return project_2d(embedded if n is None else recent(embedded, n), k, graph=graph)
