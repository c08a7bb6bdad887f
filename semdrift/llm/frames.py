"""Small frame helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, label: str, id_col: str, per_label: int, max_labels: int) -> tuple[DataFrame, list]:
    """About ``per_label`` rows of each label, chosen by the hash of the id, and the labels by falling count.

    Meant for fitting classifiers. Labels after the first ``max_labels`` are left out.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(max_labels).collect()
    labels = [r[0] for r in counts]
    if not labels:
        return df.limit(0), []
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), F.lit(1_000_000))
    rate = F.lit(None)
    for r in counts:
        rate = F.when(F.col(label) == F.lit(r[0]), int(min(1.0, per_label / r[1]) * 1_000_000)).otherwise(rate)
    return df.where(draw < rate), labels


def marked_sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, txt, lab) of about ``per_label`` documents of each of the labels 0 and 1, and how many there are of each.

    Only ids are joined to find them; the chosen ones, bounded by ``per_label``, are broadcast to fetch the texts.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("lab"))
    known = docs.select(F.col(id_col).alias("id")).join(marks, "id")
    total = {r["lab"]: r["count"] for r in known.groupBy("lab").count().collect()}
    chosen, _ = bounded_sample(known, "lab", "id", per_label, 2)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("txt"))
    return texts.join(F.broadcast(chosen.distinct()), "id"), total
