"""Connected components of link tables by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.scale import cut


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in ``links`` (a, b): rows (id, component_id).

    Every round sends a vertex's label to its neighbours and then jumps to the label of its label, so the
    number of rounds grows with the logarithm of the longest chain in practice. Rows with nulls are ignored.
    All aggregates are minima with map-side reduction; a hub vertex is no special case.
    """
    clean = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = cut(clean.union(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        heard = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard, F.col("id") == F.col("a")).select("id", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        top = labels.select(F.col("id").alias("t"), F.col("label").alias("jump"))
        new = cut(near.join(top, F.col("label") == F.col("t"), "left").select("id", "old", F.least("label", F.coalesce("jump", "label")).alias("label")))
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component_id")
