"""Document quality by hierarchical empirical Bayes.

A text classifier gives each document evidence of its own. The evidence of the other documents of its site, and of
its part (path) of the site, forms posteriors: a site with few documents is drawn to the global share, a path with few
documents to its site. The draw of each level follows from the variances that the table itself shows: of documents
within a path, of paths within a site, of sites. A document's final log-odds add what its path says beyond the global
share; its own evidence is left out of both posteriors, so it counts once. Where sites or paths differ no more than
chance would have them differ, a variance is 0 and that level says nothing.

Null and empty texts have the evidence of an empty text. Null sites and paths are groups of their own. Every row
is judged, repeated ids included. Without labels of both kinds all evidence is the labelled share, or 0.5.
Extra columns are ignored. Sites and paths of any size are summed with map-side partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.llm.frames import marked_sample
from semdrift.scale import cut, small_side

DIM = 1 << 11
# The classifier is fitted on about this many labelled documents of each kind.
SAMPLE_PER_LABEL = 1500
_PIECE = 1 << 20
_CLIP = 6.0
# Variances are not taken as less than this share of the one below them.
_LEAST = 1e-9


def features(text: str | None) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed byte pairs and of the kinds of three characters in a row."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(DIM, np.int64)
    for at in range(0, max(1, len(raw) - 1), _PIECE):
        b = raw[at : at + _PIECE + 2].astype(np.uint32)
        if len(b) < 3:
            continue
        kind = _KIND[b]
        counts += np.bincount(((b[:-1] | b[1:] << np.uint32(8)) * np.uint32(2654435761)) >> np.uint32(22), minlength=DIM)
        shape = kind[:-2] * 100 + kind[1:-1] * 10 + kind[2:]
        counts += np.bincount(1024 + shape, minlength=DIM)
    out = np.sqrt(counts.astype(np.float32))
    return out / max(float(np.linalg.norm(out)), 1e-9)


def _kinds() -> np.ndarray:
    out = np.full(256, 9, np.int64)
    for c in range(128):
        ch = chr(c)
        out[c] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch in " \t" else 4 if ch in "\r\n" else 5 if ch in ".,;:'-" else 6 if ch in "!?" else 7
    return out


_KIND = _kinds()


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Balanced logistic regression by gradient descent with momentum; bias last."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    beta, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        speed = 0.9 * speed - 4.0 * (x.T @ (w * (p - y)) + ridge * np.append(beta[:-1], 0) * 0.1)
        beta = beta + speed
    return beta


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> np.ndarray:
    """Weights of the text classifier, fitted on a bounded sample of the documents that ``labels`` marks 0 or 1."""
    sample, total = marked_sample(docs, labels, id_col, text, label, per_label)
    beta = np.zeros(DIM + 1)
    if not (total.get(0) and total.get(1)):
        if total:
            beta[-1] = _CLIP if total.get(1) else -_CLIP
        return beta

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).astype(np.float16).tobytes() for t in batch["txt"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"].cast(pa.string()), batch["lab"], pa.array(x, pa.binary())], names=["id", "lab", "x"])

    rows = sorted(sample.select("id", "lab", "txt").mapInArrow(encode, "id string, lab int, x binary").collect(), key=lambda r: (r["lab"], r["id"], bytes(r["x"])))
    if len({r["lab"] for r in rows}) < 2:
        return beta
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32)
    return _fit(x, np.array([r["lab"] for r in rows], float))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


@dataclass(frozen=True)
class Spread:
    """Global share, and the variances of documents within a path, of paths within a site, and of sites."""

    rate: float
    within: float
    paths: float
    sites: float


def spread(paths: DataFrame) -> Spread:
    """Nested analysis of variance for groups of any sizes, over (site, path, n, s, q): rows, sum and sum of squares.

    Without two documents in any path the variance within is the binomial one. One row reaches the driver.
    """
    n, s = F.col("n"), F.col("s")
    sites = paths.groupBy("site").agg(
        F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("paths"),
        F.sum(s * s / n).alias("told"), F.sum(n.cast("double") * n).alias("squares"),
    )
    t = sites.agg(
        F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum("q").alias("q"), F.sum("paths").alias("paths"), F.count(F.lit(1)).alias("sites"),
        F.sum("told").alias("by_path"), F.sum(s * s / n).alias("by_site"), F.sum("squares").alias("path_squares"),
        F.sum(F.col("squares") / n).alias("shared"), F.sum(n.cast("double") * n).alias("site_squares"),
    ).first()
    if not t["n"]:
        return Spread(0.5, 1.0, 1.0, 0.0)
    rate = min(max(t["s"] / t["n"], 1e-6), 1 - 1e-6)
    free = t["n"] - t["paths"]
    within = max((t["q"] - t["by_path"]) / free, _LEAST) if free else rate * (1 - rate)
    spare = t["n"] - t["shared"]
    between = (t["by_path"] - t["by_site"] - (t["paths"] - t["sites"]) * within) / spare if spare > 1e-9 * t["n"] else 0.0
    between = max(between, _LEAST * within)
    spare = t["n"] - t["site_squares"] / t["n"]
    noise = (t["sites"] - 1) * within + between * (t["shared"] - t["path_squares"] / t["n"])
    apart = (t["by_site"] - t["s"] * t["s"] / t["n"] - noise) / spare if spare > 1e-9 * t["n"] else 0.0
    return Spread(rate, within, between, max(apart, 0.0))


def _inside(rate: Column) -> Column:
    return F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))


def judge_quality(docs: DataFrame, weights: np.ndarray, site: Column, path: Column, id_col: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, evidence, site_rate, path_rate, quality, keep) for each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(site.cast("string"), F.lit("\0null")).alias("site"), F.coalesce(path.cast("string"), F.lit("\0null")).alias("path"), F.col(text).alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch["text"].to_pylist()], np.float32).reshape(-1, DIM)
            z = np.clip(x @ weights[:-1].astype(np.float32) + weights[-1], -_CLIP, _CLIP)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["site"], batch["path"], pa.array(1 / (1 + np.exp(-z.astype(np.float64))))], names=["doc_id", "site", "path", "p"])

    judged = cut(rows.mapInArrow(weigh, rows.select("doc_id", "site", "path", F.lit(0.0).alias("p")).schema))
    paths = cut(judged.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    level = spread(paths)
    ratio = level.within / level.paths
    pull = F.col("n") + ratio
    sites = paths.groupBy("site").agg(F.sum(F.col("n") / pull).alias("weight"), F.sum(F.col("s") / pull).alias("said"))
    out = judged.join(small_side(paths.select("site", "path", "n", "s").join(sites, "site")), ["site", "path"])
    # The document's path without it; the site's sums change by that path's share.
    rest = F.col("n") - 1 + ratio
    weight = F.col("weight") - F.col("n") / pull + (F.col("n") - 1) / rest
    said = F.col("said") - F.col("s") / pull + (F.col("s") - F.col("p")) / rest
    out = out.withColumn("site_rate", _inside((level.sites * said + level.paths * level.rate) / (level.sites * weight + level.paths)))
    out = out.withColumn("path_rate", _inside((F.col("s") - F.col("p") + ratio * F.col("site_rate")) / rest))
    z = _logit(F.col("p")) + _logit(F.col("path_rate")) - F.lit(float(np.log(level.rate / (1 - level.rate))))
    quality = 1 / (1 + F.exp(-z))
    rounded = [F.round(c, 9).alias(n) for c, n in ((F.col("p"), "evidence"), (F.col("site_rate"), "site_rate"), (F.col("path_rate"), "path_rate"), (quality, "quality"))]
    return out.select("doc_id", *rounded).withColumn("keep", F.col("quality") >= threshold)
