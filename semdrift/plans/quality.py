"""Acceptance checks. Each returns one row: name, passed, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.operators.neighbours import top_k
from semdrift.operators.rollups import COHORTS


def _result(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail")
    )


def check_cohorts(events: DataFrame) -> DataFrame:
    """All cohorts occur."""
    counts = events.agg(*[F.count_if(F.col("cohort") == c).alias(c) for c in COHORTS])
    passed = F.lit(True)
    for c in COHORTS:
        passed = passed & (F.col(c) > 0)
    detail = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in COHORTS])
    return _result(counts, "all cohorts present", passed, detail)


def check_no_loss(stored: DataFrame, published: DataFrame) -> DataFrame:
    """Everything published is stored, a whole number of times."""
    both = stored.select(F.lit(1).alias("s"), F.lit(0).alias("p")).unionAll(
        published.select(F.lit(0).alias("s"), F.lit(1).alias("p"))
    )
    n = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"))
    passed = (F.col("p") > 0) & (F.col("s") >= F.col("p")) & (F.try_mod("s", "p") == 0)
    return _result(n, "no ingestion loss", passed, F.concat("s", F.lit(" stored, "), "p", F.lit(" published")))


def _check_embedded(events: DataFrame, frame: str, text: str, vector: str, name: str) -> DataFrame:
    missing = (F.col("frame_type") == frame) & F.col(text).isNotNull() & F.col(vector).isNull()
    n = events.agg(F.count_if(missing).alias("n"))
    return _result(n, name, F.col("n") == 0, F.concat("n", F.lit(" rows without a vector")))


def check_prompt_embeddings(events: DataFrame) -> DataFrame:
    return _check_embedded(events, "request_body", "prompt_text", "prompt_embedding", "prompts are embedded")


def check_completion_embeddings(events: DataFrame) -> DataFrame:
    return _check_embedded(
        events, "response_body", "completion_text", "completion_embedding", "completions are embedded"
    )


def check_knn(events: DataFrame, query: list[float]) -> DataFrame:
    """The nearest prompt to a known normal one is close and normal."""
    best = top_k(events.where(F.col("prompt_embedding").isNotNull()), query, 5)
    first = F.min_by(F.struct("similarity", "cohort"), F.struct(-F.col("similarity"), F.col("request_id")))
    top = best.agg(first.alias("t")).select("t.*")
    passed = (F.col("similarity") > 0.5) & (F.col("cohort") == "normal")
    detail = F.concat(F.lit("top cohort="), F.coalesce("cohort", F.lit("none")))
    return _result(top, "nearest neighbours are plausible", passed, detail)


def check_drift_knn(events: DataFrame, query: list[float]) -> DataFrame:
    """Most of the ten nearest prompts to a known drift one are drift."""
    best = top_k(events.where(F.col("prompt_embedding").isNotNull()), query, 10)
    n = best.agg(F.count_if(F.col("cohort") == "drift").alias("n"))
    return _result(n, "drift is detectable by similarity", F.col("n") >= 6, F.concat("n", F.lit("/10 are drift")))


def check_detector(baselines: DataFrame, drift: DataFrame) -> DataFrame:
    """A baseline exists, a session is flagged, and a flagged session is real drift: one row each."""
    routes = baselines.agg(F.count(F.lit(1)).alias("n"))
    flagged = drift.agg(F.count(F.lit(1)).alias("n"))
    true = drift.agg(F.count_if(F.col("cohort") == "drift").alias("n"))

    def row(df: DataFrame, name: str) -> DataFrame:
        return _result(df, name, F.col("n") > 0, F.col("n").cast("string"))

    return (
        row(routes, "a route has a baseline")
        .unionByName(row(flagged, "a session is flagged"))
        .unionByName(row(true, "a flagged session is drift"))
    )


def is_settled(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Whether the counts per route (route, n) stayed the same between two looks.

    Routes only the earlier look knew are not asked about again. No routes, or
    a route not seen before, means not settled.
    """
    seen = previous.select("route", F.col("n").alias("before"))
    same = current.join(seen, "route", "left").agg(F.every(F.coalesce(F.col("n") == F.col("before"), F.lit(False))).alias("s"))
    return same.select(F.coalesce("s", F.lit(False)).alias("settled"))
