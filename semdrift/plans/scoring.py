"""Online scoring: which sessions drift from their route's baseline or repeat remembered drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.config import DetectorConfig
from semdrift.functions.encode import Encoder, embed_text
from semdrift.functions.scalars import flagged_by
from semdrift.operators import rollups as R
from semdrift.operators.block_search import nearest_memory, with_text
from semdrift.operators.filters import embedded_events, online_candidates
from semdrift.operators.merge import DRIFT_COLUMNS, MEMORY_COLUMNS, remember
from semdrift.operators.threshold_join import ThresholdPlan, known_matches
from semdrift.plans.baseline import Baseline, score_nearest
from semdrift.scale import cut, small_side

# The order in which a pass looks at turns.
TURN_ORDER = ["event_ts", "route", "session_id", "request_id"]
# Fixed value: route checked when none is named.
DEFAULT_ROUTE = "/llm"


@dataclass
class Scores:
    """Scored online turns, the flagged sessions and the rows to add to the memory."""

    turns: DataFrame
    drift: DataFrame
    memory: DataFrame


def score_turns(
    events: DataFrame, baseline: Baseline, memory: DataFrame, cfg: DetectorConfig = DetectorConfig()
) -> DataFrame:
    """Online turns with distance, threshold, similarity and both hit flags.

    Turns without a session cannot be reported and are left out.
    """
    limits = small_side(baseline.routes.select("route", "threshold", "window_end"), stored=True)
    columns = ["request_id", "session_id", "route", "event_ts", "prompt_text", "cohort", "prompt_embedding"]
    turns = online_candidates(embedded_events(events).select(*columns), limits)
    turns = turns.where(F.col("session_id").isNotNull()).join(limits.select("route", "threshold"), "route")
    scored = score_nearest(turns, baseline.clusters, cfg)
    matched = nearest_memory(scored, memory, cfg.memory_book_bytes)
    return with_hits(matched, cfg)


def with_hits(scored: DataFrame, cfg: DetectorConfig) -> DataFrame:
    return scored.withColumns(
        {
            "baseline_hit": F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)),
            "memory_hit": F.coalesce(F.col("similarity") >= cfg.memory_threshold, F.lit(False)),
        }
    )


def drift_events(scored: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """One row per flagged session and route.

    The trigger is the worst turn, or the best memory match when the distance
    alone raised no flag; the distance is the worst one either way. All of it
    is one aggregation with small partial states, so a session of any size
    is reduced before the shuffle.
    """
    sessions = scored.groupBy("route", "session_id", "threshold").agg(
        R.worst_turn_of().alias("worst"),
        R.best_memory_turn_of(cfg.memory_threshold).alias("repeat"),
        F.count(F.lit(1)).cast("int").alias("turn_count"),
    )
    return flag(sessions)


def flag(sessions: DataFrame) -> DataFrame:
    """Rolled-up sessions (worst, repeat, turn_count, threshold) to drift event rows."""
    distance = F.coalesce(F.col("worst.distance"), F.lit(-1.0))
    statistical = distance > F.col("threshold")
    repeat = F.col("repeat").isNotNull()

    def trigger(field: str):
        return F.when(statistical, F.col(f"worst.{field}")).otherwise(F.col(f"repeat.{field}"))

    return sessions.where(statistical | repeat).select(
        "session_id", "route",
        trigger("request_id").alias("worst_request_id"),
        trigger("event_ts").alias("worst_event_ts"),
        trigger("prompt_text").alias("worst_prompt_text"),
        trigger("cohort").alias("cohort"),
        distance.alias("distance"), "threshold", "turn_count",
        flagged_by(statistical, repeat).alias("flagged_by"),
        F.current_timestamp().alias("detected_at"),
    )


def new_memory(scored: DataFrame) -> DataFrame:
    """Every turn hit by either signal, as memory rows with its own distance."""
    hits = scored.where(F.col("baseline_hit") | F.col("memory_hit"))
    return hits.select(
        F.col("request_id").alias("source_request_id"),
        F.col("session_id").alias("source_session_id"),
        F.col("route").alias("source_route"),
        "prompt_text",
        F.col("prompt_embedding").alias("embedding"),
        F.coalesce("distance", F.lit(-1.0)).alias("distance"),
        F.current_timestamp().alias("added_at"),
        "event_ts",
    )


def score_sessions(
    events: DataFrame,
    baseline: Baseline,
    memory: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
    transitive: bool = False,
    plan: ThresholdPlan = ThresholdPlan(),
) -> Scores:
    """One pass over all routes and sessions.

    Turns are compared with the memory as it stood before the pass. With ``transitive`` the memory grows during the
    pass: a turn also matches the hits that come before it, in the order of ``TURN_ORDER``, as a loop over the turns
    would find them.
    """
    turns = score_turns(events, baseline, memory, cfg)
    if transitive:
        turns = grown_memory(cut(turns), cfg, plan)
    turns = cut(turns)
    added = remember(memory, new_memory(turns)).select(*MEMORY_COLUMNS)
    return Scores(turns, drift_events(turns, cfg).select(*DRIFT_COLUMNS), added)


def grown_memory(turns: DataFrame, cfg: DetectorConfig = DetectorConfig(), plan: ThresholdPlan = ThresholdPlan()) -> DataFrame:
    """Scored turns after a pass in which every hit is remembered at once and matched by later turns.

    What counts is when each distinct vector is first remembered. That time spreads over pairs that are similar enough:
    a vector's first turn after the earliest time among its neighbours is a hit too. Rounds go on from the vectors
    whose time became earlier, until none does, so a chain of n turns takes n rounds at most. A round compares all
    vectors with those only; pairs are never listed, as at a low threshold they are a share of all (``known_matches``).
    """
    vid = F.concat(F.hex(F.xxhash64("prompt_embedding")), F.hex(F.xxhash64("prompt_embedding", F.lit(1)))).alias("vid")
    place = F.struct(*TURN_ORDER).alias("place")
    found = turns.where(F.col("prompt_embedding").isNotNull())
    steps = cut(found.select(vid, place, (F.col("baseline_hit") | F.col("memory_hit")).alias("hit")))
    vectors = cut(found.select(vid.alias("a"), F.col("prompt_embedding").alias("vector")).groupBy("a").agg(F.first("vector").alias("vector")))

    def matches(times: DataFrame, first: bool) -> DataFrame:
        known = vectors.join(times.withColumnRenamed("vid", "a"), "a").withColumnRenamed("a", "b")
        return known_matches(vectors, known, cfg.memory_threshold, first, plan)

    since = cut(steps.where("hit").groupBy("vid").agg(F.min("place").alias("since")))
    fresh = since
    while not fresh.isEmpty():
        heard = matches(fresh, True).groupBy("a").agg(F.min("since").alias("heard"))
        then = steps.join(heard, F.col("vid") == F.col("a")).where(F.col("place") > F.col("heard")).groupBy("vid").agg(F.min("place").alias("then"))
        fresh = cut(then.join(since, "vid", "left").where(F.col("since").isNull() | (F.col("then") < F.col("since"))).select("vid", F.col("then").alias("since")))
        since = cut(since.unionByName(fresh).groupBy("vid").agg(F.min("since").alias("since")))
    # Per turn the most similar vector that was remembered before it; of equals the one with the smallest request id.
    rung = F.struct((-F.col("similarity")).alias("s"), F.col("since.request_id").alias("request_id"), "since")
    known = matches(since, False).groupBy("a").agg(F.collect_list(rung).alias("rungs"))
    before = F.filter("rungs", lambda r: r.since < F.col("place"))
    near = steps.join(known, F.col("vid") == F.col("a")).select("place", F.array_min(before).alias("m")).where("m is not null")
    again = near.select("place.*", (-F.col("m.s")).alias("similarity"), F.col("m.request_id").alias("matched_request_id"))
    closer = _closer(turns.drop("memory_hit"), again)
    return closer.withColumn("memory_hit", F.coalesce(F.col("similarity") >= cfg.memory_threshold, F.lit(False)))


def _closer(turns: DataFrame, again: DataFrame) -> DataFrame:
    """Turns with the better of two memory matches."""
    key = ["route", "session_id", "request_id", "event_ts"]
    match = F.struct(F.coalesce("similarity", F.lit(-2.0)).alias("similarity"), "matched_request_id")
    new = again.groupBy(*key).agg(F.max(match).alias("_new"))
    old = turns.withColumn("_old", match).drop("similarity", "matched_request_id")
    joined = old.alias("o").join(new.alias("n"), key, "left")
    best = F.greatest("_old", "_new")
    return joined.withColumn("_best", best).select(
        *[c for c in old.columns if c != "_old"],
        F.nullif(F.col("_best.similarity"), F.lit(-2.0)).alias("similarity"),
        F.col("_best.matched_request_id").alias("matched_request_id"),
    )


def check_prompts(
    prompts: DataFrame, baseline: Baseline, memory: DataFrame, cfg: DetectorConfig = DetectorConfig()
) -> DataFrame:
    """Verdict for prompts without storing anything; routes without a baseline give no verdict.

    ``prompts``: request_id, prompt_embedding and optionally route.
    """
    if "route" not in prompts.columns:
        prompts = prompts.withColumn("route", F.lit(DEFAULT_ROUTE))
    limits = small_side(baseline.routes.select("route", "threshold"), stored=True)
    scored = score_nearest(prompts.join(limits, "route"), baseline.clusters, cfg)
    matched = with_text(nearest_memory(scored, memory, cfg.memory_book_bytes), memory)
    checked = with_hits(matched, cfg)
    return checked.withColumn("flagged_by", flagged_by(F.col("baseline_hit"), F.col("memory_hit")))


def check_texts(
    prompts: DataFrame,
    baseline: Baseline,
    memory: DataFrame,
    cfg: DetectorConfig = DetectorConfig(),
    encoder: Encoder | None = None,
) -> DataFrame:
    """``check_prompts`` for texts: request_id, prompt_text and optionally route."""
    embedded = embed_text(prompts, "prompt_text", "prompt_embedding", "query", encoder)
    return check_prompts(embedded, baseline, memory, cfg)
