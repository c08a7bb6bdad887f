"""Checks of vectors, baselines, memory and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.checks import sqltext as Q
from semdrift.checks import views as W
from semdrift.checks.registry import query, r6, wall
from semdrift.config import DetectorConfig
from semdrift.functions import vectors as V
from semdrift.functions.encode import embed_text
from semdrift.operators import filters, joins, merge, neighbours, ordering, threshold_join, vector_index
from semdrift.operators import rollups as R
from semdrift.operators.block_search import BlockPlan, nearest_memory
from semdrift.plans import baseline as B
from semdrift.plans import quality, reports, scoring, spread, topics
from semdrift.scale import cut, scratch_path, small_side
from semdrift.sources.baselines import join_clusters

CFG = DetectorConfig()
SINGLE = DetectorConfig(n_clusters=1)

DRIFT_OUT = (
    "session_id, route, worst_request_id, worst_event_ts, worst_prompt_text, cohort, round(distance, 6) as distance, "
    "round(threshold, 6) as threshold, turn_count, flagged_by"
)


def windows(turns: DataFrame) -> DataFrame:
    return small_side(B.route_windows(turns, CFG.baseline_fraction))


def fitted(turns: DataFrame, cfg: DetectorConfig = CFG) -> B.Baseline:
    return B.compute_baselines(turns, cfg, Q.ROUNDS)


def memory(turns: DataFrame) -> DataFrame:
    return W.memory_of(turns, windows(turns))


def scores(spark: SparkSession, d: str) -> scoring.Scores:
    turns = W.scored_events(spark, d)
    return scoring.score_sessions(turns, fitted(turns), memory(turns), CFG)


def scored_turns(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    return scoring.score_turns(turns, fitted(turns), memory(turns), CFG)


def drift_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id", "route", "worst_request_id", wall("worst_event_ts").alias("worst_event_ts"), "worst_prompt_text",
        "cohort", r6("distance").alias("distance"), r6("threshold").alias("threshold"), "turn_count", "flagged_by",
    )


# ---- flagship -------------------------------------------------------------


@query(
    "flagged_sessions_single_cluster",
    "M-11 M-02 A-05 A-06 W-01",
    f"with {Q.baseline(0, 1)}, "
    f"""ot as (
  select s.session_id, s.route, s.request_id, s.event_ts, b.threshold, {Q.distance("s.prompt_embedding", "c")} as distance
  from se s join bl b on b.route = s.route and s.event_ts > b.window_end join cl c on c.route = s.route
), w as (
  select *, count(*) over (partition by route, session_id) as turns from ot
  qualify row_number() over (partition by route, session_id order by distance desc, event_ts, request_id) = 1
)
select session_id, route, request_id, event_ts, round(distance, 6) as distance, round(threshold, 6) as threshold,
       cast(turns as integer) as turn_count
from w where distance > threshold""",
)
def flagged_sessions_single_cluster(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    base = B.compute_baselines(turns, SINGLE)
    limits = small_side(base.routes.select("route", "threshold", "window_end"))
    online = filters.online_candidates(filters.embedded_events(turns), limits)
    scored = B.score_nearest(online, base.clusters, SINGLE)
    worst = R.worst_turn(scored).join(R.session_rollup(scored), ["route", "session_id"])
    flagged = worst.join(limits.select("route", "threshold"), "route").where(F.col("distance") > F.col("threshold"))
    return flagged.select(
        "session_id", "route", "request_id", "event_ts", r6("distance").alias("distance"),
        r6("threshold").alias("threshold"), "turn_count",
    )


# ---- vectors --------------------------------------------------------------


@query(
    "cosine_similarity",
    "M-01",
    f"with {W.SCORED_EVENTS}, {W.LABEL_QUERIES} "
    "select request_id, round(list_cosine_similarity(prompt_embedding, vector), 6) as similarity, "
    "round(1 - list_cosine_similarity(prompt_embedding, vector), 6) as distance "
    "from se join qv on qv.query_id = 'label-' || cast(kafka_offset % 10 as varchar)",
)
def cosine_similarity(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d).withColumn("query_id", F.concat(F.lit("label-"), F.col("kafka_offset") % 10))
    pairs = turns.join(W.label_queries(spark, d), "query_id")
    similarity = V.cosine_similarity(F.col("prompt_embedding"), F.col("vector"))
    return pairs.select(
        "request_id", r6(similarity).alias("similarity"),
        r6(V.cosine_distance(F.col("prompt_embedding"), F.col("vector"))).alias("distance"),
    )


NEAREST_CLUSTER_SQL = (
    f"with {Q.baseline()}, nd as (select s.request_id, s.route, c.cluster_id, "
    f"{Q.distance('s.prompt_embedding', 'c')} as distance from se s join cl c on c.route = s.route) "
)


@query(
    "mahalanobis_to_each_cluster",
    "M-02",
    NEAREST_CLUSTER_SQL + "select request_id, cluster_id, round(distance, 6) as distance from nd",
)
def mahalanobis_to_each_cluster(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    clusters = small_side(fitted(turns).clusters)
    pairs = turns.join(clusters.select("route", "cluster_id", "centroid", "variance"), "route")
    distance = V.diag_mahalanobis(F.col("prompt_embedding"), F.col("centroid"), F.col("variance"))
    return pairs.select("request_id", "cluster_id", r6(distance).alias("distance"))


@query(
    "nearest_cluster",
    "M-03 M-04",
    NEAREST_CLUSTER_SQL + "select request_id, cluster_id, round(distance, 6) as distance from nd "
    "qualify row_number() over (partition by request_id order by distance, cluster_id) = 1",
)
def nearest_cluster(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    scored = B.score_nearest(turns, fitted(turns).clusters)
    return scored.select("request_id", "cluster_id", r6("distance").alias("distance"))


@query(
    "effective_k",
    "M-05",
    f"with {W.SCORED_EVENTS} select route, session_id, count(*) as n, "
    "cast(greatest(1, least(4, count(*) // 30)) as integer) as k from se group by route, session_id",
)
def effective_k(spark: SparkSession, d: str) -> DataFrame:
    counts = W.scored_events(spark, d).groupBy("route", "session_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("k", V.effective_k(F.col("n"), CFG.n_clusters, CFG.samples_per_cluster))


@query(
    "nearest_cluster_joined",
    "M-03 M-04",
    NEAREST_CLUSTER_SQL + "select request_id, cluster_id, round(distance, 6) as distance from nd "
    "qualify row_number() over (partition by request_id order by distance, cluster_id) = 1",
)
def nearest_cluster_joined(spark: SparkSession, d: str) -> DataFrame:
    """The way that large cluster tables take."""
    turns = W.scored_events(spark, d)
    scored = B.score_nearest(turns, fitted(turns).clusters, DetectorConfig(cluster_book_bytes=0))
    return scored.select("request_id", "cluster_id", r6("distance").alias("distance"))


# ---- baseline -------------------------------------------------------------


@query(
    "baseline_routes",
    "M-11 A-03 A-06 F-02 X-04",
    f"with {Q.baseline()} select route, sample_count, n_clusters, round(threshold, 6) as threshold, "
    "window_start, window_end from bl",
)
def baseline_routes(spark: SparkSession, d: str) -> DataFrame:
    return fitted(W.scored_events(spark, d)).routes.select(
        "route", "sample_count", "n_clusters", r6("threshold").alias("threshold"),
        wall("window_start").alias("window_start"), wall("window_end").alias("window_end"),
    )


@query(
    "route_clusters",
    "M-06 A-05",
    f"with {Q.baseline()} select route, cluster_id, sample_count, cast(pos - 1 as integer) as pos, "
    "round(centroid[pos], 6) as centroid, round(variance[pos], 6) as variance "
    "from (select *, unnest(range(1, len(centroid) + 1)) as pos from cl)",
)
def route_clusters(spark: SparkSession, d: str) -> DataFrame:
    clusters = fitted(W.scored_events(spark, d)).clusters
    dims = clusters.select(
        "route", "cluster_id", "sample_count", F.posexplode(F.arrays_zip("centroid", "variance")).alias("pos", "s")
    )
    return dims.select(
        "route", "cluster_id", "sample_count", "pos", r6("s.centroid").alias("centroid"), r6("s.variance").alias("variance")
    )


@query(
    "spread_clusters",
    "M-06",
    f"with {Q.baseline()} select route, sample_count, true as tight from bl",
)
def spread_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Spread seeds and mini-batches lose at most 5 % against full rounds on any route, with every row in a cluster."""
    turns = W.scored_events(spark, d)
    mine = B.compute_baselines(turns, CFG, fit=spread.fit_spread_clusters).clusters
    full = spread.inertia(fitted(turns).clusters).withColumnRenamed("inertia", "full")
    counted = mine.groupBy("route").agg(F.sum("sample_count").cast("int").alias("sample_count"))
    both = counted.join(spread.inertia(mine), "route").join(full, "route", "left")
    return both.select("route", "sample_count", (F.col("inertia") <= 1.05 * F.col("full")).alias("tight"))


@query(
    "cohort_vector_stats",
    "A-05",
    f"""with {W.SCORED_EVENTS} select route, cluster_id, cast(count(*) as integer) as sample_count, pos,
round(avg(v), 6) as centroid, round(var_pop(v), 6) as variance
from (select route, cast(strlen(cohort) as integer) as cluster_id, cast(p - 1 as integer) as pos, prompt_embedding[p] as v
      from (select *, unnest(range(1, len(prompt_embedding) + 1)) as p from se)) group by route, cluster_id, pos""",
)
def cohort_vector_stats(spark: SparkSession, d: str) -> DataFrame:
    labelled = W.scored_events(spark, d).withColumn("cluster_id", F.length("cohort"))
    stats = R.cluster_stats(labelled).select(
        "route", "cluster_id", "sample_count", F.posexplode(F.arrays_zip("centroid", "variance")).alias("pos", "s")
    )
    return stats.select(
        "route", "cluster_id", "sample_count", "pos", r6("s.centroid").alias("centroid"), r6("s.variance").alias("variance")
    )


@query(
    "route_threshold",
    "A-06",
    f"with {Q.baseline()} select route, round(avg(distance) + 2.0 * stddev_pop(distance), 6) as threshold "
    "from sd group by route",
)
def route_threshold(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    sample = filters.baseline_window(turns, windows(turns))
    scored = B.score_nearest(sample, fitted(turns).clusters)
    return R.route_threshold(scored, CFG.sigma).select("route", r6("threshold").alias("threshold"))


@query(
    "baseline_with_clusters",
    "S-04 J-02",
    f"with {Q.baseline()} select s.request_id, round(b.threshold, 6) as threshold, "
    "cast(count(*) as integer) as n_clusters, min(c.cluster_id) as first_cluster "
    "from se s join bl b on b.route = s.route join cl c on c.route = s.route group by s.request_id, b.threshold",
)
def baseline_with_clusters(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    base = fitted(turns)
    joined = joins.join_baseline(turns, join_clusters(base.routes, base.clusters))
    return joined.select(
        "request_id", r6("threshold").alias("threshold"), F.size("clusters").alias("n_clusters"),
        F.col("clusters")[0].cluster_id.alias("first_cluster"),
    )


@query(
    "baseline_upsert",
    "K-02",
    f"with {Q.baseline()} select route, case when route = 'view' then -1 else sample_count end as sample_count, "
    "case when route = 'view' then 'old' else 'new' end as version from bl "
    "union all select 'retired', -1, 'old'",
)
def baseline_upsert(spark: SparkSession, d: str) -> DataFrame:
    routes = fitted(W.scored_events(spark, d)).routes.select("route", "sample_count")
    stored = routes.select("route", F.lit(-1).alias("sample_count"))
    gone = spark.range(1).select(F.lit("retired").alias("route"), F.lit(-1).alias("sample_count"))
    old = stored.unionByName(gone).withColumn("version", F.lit("old"))
    # One route had too few samples this time and keeps its stored row.
    new = routes.where(F.col("route") != "view").withColumn("version", F.lit("new"))
    return merge.upsert_baselines(old, new)


@query(
    "cluster_replace",
    "K-03",
    f"with {Q.baseline()} select route, cluster_id, sample_count from cl where route <> 'view' "
    "union all select route, cluster_id + 100, -1 from cl where route = 'view'",
)
def cluster_replace(spark: SparkSession, d: str) -> DataFrame:
    clusters = fitted(W.scored_events(spark, d)).clusters.select("route", "cluster_id", "sample_count")
    old = clusters.select("route", (F.col("cluster_id") + 100).alias("cluster_id"), F.lit(-1).alias("sample_count"))
    return merge.replace_clusters(old, clusters.where(F.col("route") != "view"))


# ---- memory and scoring ---------------------------------------------------


@query(
    "nearest_memory",
    "J-03",
    f"with {Q.WINDOWS + Q.NEAREST} select s.request_id, round(n.similarity, 6) as similarity, n.matched_request_id "
    "from se s left join nm n on n.v = s.prompt_embedding",
)
def nearest_memory_rows(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    found = nearest_memory(turns, memory(turns))
    return found.select("request_id", r6("similarity").alias("similarity"), "matched_request_id")


@query(
    "nearest_memory_blocks",
    "J-03",
    f"with {Q.WINDOWS + Q.NEAREST} select s.request_id, round(n.similarity, 6) as similarity, n.matched_request_id "
    "from se s left join nm n on n.v = s.prompt_embedding",
)
def nearest_memory_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The way that large memories take, with several blocks and groups."""
    turns = W.scored_events(spark, d)
    plan = BlockPlan(block_bytes=32 * 1024, group_rows=4000)
    found = nearest_memory(turns, memory(turns), book_bytes=0, blocks=plan)
    return found.select("request_id", r6("similarity").alias("similarity"), "matched_request_id")


@query(
    "memory_hits",
    "M-13",
    f"with {Q.WINDOWS + Q.NEAREST} select s.request_id, s.route, round(n.similarity, 6) as similarity "
    "from se s join nm n on n.v = s.prompt_embedding where n.similarity >= 0.9",
)
def memory_hits(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    hits = neighbours.memory_hits(turns, memory(turns), CFG.memory_threshold)
    return hits.select("request_id", "route", r6("similarity").alias("similarity"))


@query(
    "threshold_join_work",
    "M-13 J-03",
    f"with {Q.WINDOWS + Q.NEAREST} select (select count(*) from nm) * (select count(distinct embedding) from dm) as pairs, true as few_compared",
)
def threshold_join_work(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct vectors, and whether less than a tenth of them were multiplied out."""
    turns = W.scored_events(spark, d)
    counts = threshold_join.matches(turns, memory(turns), CFG.memory_threshold)[1]
    return counts.select("pairs", (F.col("verified") < 0.1 * F.col("pairs")).alias("few_compared"))


GROWN_SQL = f"""with recursive {W.SCORED_EVENTS},
vs as materialized (select row_number() over () as vid, v from (select distinct prompt_embedding as v from se)),
tn as materialized (
  select s.request_id, v.vid, s.kafka_offset % 997 = 0 as seed, row_number() over (order by s.event_ts, s.route, s.session_id, s.request_id) as place
  from se s join vs v on v.v = s.prompt_embedding),
pr as materialized (
  select a.vid as a, b.vid as b, round(list_cosine_similarity(a.v, b.v), 12) as sim from vs a join vs b
  on round(list_cosine_similarity(a.v, b.v), 12) >= 0.34),
reached as (
  select place, vid from tn where seed
  union
  select t.place, t.vid from reached r join pr p on p.b = r.vid join tn t on t.vid = p.a and t.place > r.place),
since as materialized (select vid, min(place) as place from reached group by vid),
best as (
  select t.request_id, max(p.sim) as sim, arg_min(f.request_id, {{'s': -p.sim, 'r': f.request_id}}) as matched
  from tn t join pr p on p.a = t.vid join since s on s.vid = p.b and s.place < t.place join tn f on f.place = s.place
  group by t.request_id)
select t.request_id, t.seed as baseline_hit, b.sim is not null as memory_hit, round(b.sim, 6) as similarity, b.matched as matched_request_id
from tn t left join best b on b.request_id = t.request_id"""


@query("grown_memory", "M-12 K-05 M-13", GROWN_SQL)
def grown_memory(spark: SparkSession, d: str) -> DataFrame:
    """A few first hits, and what a memory that grows turn by turn makes of them at a low threshold."""
    none = {"memory_hit": F.lit(False), "similarity": F.lit(None).cast("double"), "matched_request_id": F.lit(None).cast("string")}
    turns = W.scored_events(spark, d).withColumn("baseline_hit", F.col("kafka_offset") % 997 == 0).withColumns(none)
    found = scoring.grown_memory(turns, DetectorConfig(memory_threshold=0.34))
    return found.select("request_id", "baseline_hit", "memory_hit", r6("similarity").alias("similarity"), "matched_request_id")


@query(
    "scored_turns",
    "M-12 F-03",
    f"with {Q.scored()} select request_id, session_id, route, event_ts, round(distance, 6) as distance, cluster_id, "
    "round(threshold, 6) as threshold, round(similarity, 6) as similarity, baseline_hit, memory_hit from st",
)
def scored_turn_rows(spark: SparkSession, d: str) -> DataFrame:
    return scored_turns(spark, d).select(
        "request_id", "session_id", "route", "event_ts", r6("distance").alias("distance"), "cluster_id",
        r6("threshold").alias("threshold"), r6("similarity").alias("similarity"), "baseline_hit", "memory_hit",
    )


@query("drift_events", "M-15 M-12 X-08", f"with {Q.drift()} select {DRIFT_OUT} from de")
def drift_event_rows(spark: SparkSession, d: str) -> DataFrame:
    return drift_rows(scores(spark, d).drift)


@query(
    "new_memory",
    "M-14 K-05",
    f"with {Q.scored()} select request_id as source_request_id, session_id as source_session_id, "
    "route as source_route, prompt_text, round(distance, 6) as distance from st where baseline_hit or memory_hit",
)
def new_memory(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).memory.select(
        "source_request_id", "source_session_id", "source_route", "prompt_text", r6("distance").alias("distance")
    )


@query(
    "memory_insert",
    "K-05",
    f"with {Q.scored()}, {Q.MEMORY.split('dm as')[0].strip().lstrip(',').rstrip().rstrip(',').replace('mem as', 'mem2 as')} "
    "select request_id as source_request_id from st where (baseline_hit or memory_hit) and session_id >= 'u-5' "
    "and request_id not in (select source_request_id from mem2)",
)
def memory_insert(spark: SparkSession, d: str) -> DataFrame:
    turns = scored_turns(spark, d)
    hits = scoring.new_memory(turns)
    # Part of the hits are stored already, and all arrive twice.
    stored = hits.where(F.col("source_session_id") < "u-5")
    return merge.remember(stored, hits.unionByName(hits)).select("source_request_id")


@query(
    "drift_event_upsert",
    "K-04",
    f"with {Q.drift()}, old as (select session_id, distance + case when session_id < 'u-5' then 1 else 0 end as distance, "
    "case when session_id < 'u-5' then 'higher' else 'equal' end as flagged_by from dv where session_id < 'u-9') "
    "select d.session_id, round(coalesce(o.distance, d.distance), 6) as distance, "
    "coalesce(o.flagged_by, d.flagged_by) as flagged_by from dv d left join old o using (session_id)",
)
def drift_event_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = cut(scores(spark, d).drift)
    best = merge.best_drift_events(new.withColumn("_age", F.lit(0)), "_age")
    low = F.col("session_id") < "u-5"
    # Stored rows with a higher or an equal distance both stay.
    old = best.where(F.col("session_id") < "u-9").withColumns(
        {
            "distance": F.col("distance") + F.when(low, 1.0).otherwise(0.0),
            "flagged_by": F.when(low, "higher").otherwise("equal"),
        }
    )
    merged = merge.upsert_drift_events(old, new)
    return merged.select("session_id", r6("distance").alias("distance"), "flagged_by")


@query(
    "worst_turn",
    "W-01",
    f"with {Q.scored()} select route, session_id, request_id, event_ts, round(distance, 6) as distance from st "
    "qualify row_number() over (partition by route, session_id order by distance desc, event_ts, request_id) = 1",
)
def worst_turn(spark: SparkSession, d: str) -> DataFrame:
    return R.worst_turn(scored_turns(spark, d)).select(
        "route", "session_id", "request_id", "event_ts", r6("distance").alias("distance")
    )


@query(
    "best_memory_turn",
    "W-02",
    f"with {Q.scored()} select route, session_id, request_id, event_ts, round(similarity, 6) as similarity from st "
    "where similarity >= 0.9 qualify row_number() over "
    "(partition by route, session_id order by similarity desc, event_ts, request_id) = 1",
)
def best_memory_turn(spark: SparkSession, d: str) -> DataFrame:
    return R.best_memory_turn(scored_turns(spark, d), CFG.memory_threshold).select(
        "route", "session_id", "request_id", "event_ts", r6("similarity").alias("similarity")
    )


@query(
    "session_rollup",
    "A-07",
    f"with {Q.scored()} select route, session_id, round(max(distance), 6) as worst_distance, "
    "cast(count(*) as integer) as turn_count from st group by route, session_id",
)
def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    return R.session_rollup(scored_turns(spark, d)).withColumn("worst_distance", r6("worst_distance"))


@query(
    "check_prompts",
    "M-16",
    f"""with {Q.baseline() + Q.NEAREST}, {W.LABEL_QUERIES},
pd as materialized (
  select q.query_id as request_id, c.route, min({Q.distance("q.vector", "c")}) as distance
  from qv q, cl c group by q.query_id, c.route),
ps as materialized (select q.query_id as request_id, max(sim) as similarity, min_by(m_id, {{'s': -sim, 'r': m_id}}) as matched_request_id,
              min_by(m_text, {{'s': -sim, 'r': m_id}}) as matched_text
       from (select q.query_id, m.request_id as m_id, m.prompt_text as m_text,
                    round(list_cosine_similarity(q.vector, m.embedding), 12) as sim from qv q cross join dm m) q
       group by q.query_id)
select d.request_id, d.route, round(d.distance, 6) as distance, round(b.threshold, 6) as threshold,
       round(s.similarity, 6) as similarity, s.matched_request_id, s.matched_text,
       case when d.distance > b.threshold and s.similarity >= 0.9 then 'both'
            when d.distance > b.threshold then 'baseline' when s.similarity >= 0.9 then 'memory' end as flagged_by
from pd d join ps s on s.request_id = d.request_id join bl b on b.route = d.route""",
)
def check_prompts(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    base = fitted(turns)
    extra = spark.range(1).select(F.lit("no-baseline").alias("route"))
    # Ten prompts, each asked on every route.
    asked = W.label_queries(spark, d).select(F.col("query_id").alias("request_id"), F.col("vector").alias("prompt_embedding"))
    prompts = base.routes.select("route").union(extra).join(F.broadcast(asked))
    out = scoring.check_prompts(prompts, base, memory(turns))
    return out.select(
        "request_id", "route", r6("distance").alias("distance"), r6("threshold").alias("threshold"),
        r6("similarity").alias("similarity"), "matched_request_id", "matched_text", "flagged_by",
    )


# ---- search ---------------------------------------------------------------

NEAREST_SQL = (
    f"with {W.SCORED_EVENTS}, {W.LABEL_QUERIES}, ns as (select s.*, q.query_id, "
    "round(list_cosine_similarity(s.prompt_embedding, q.vector), 12) as sim from se s join qv q on {on}) "
)


@query(
    "nearest_prompts",
    "M-09 T-02 P-10",
    NEAREST_SQL.format(on="q.query_id = 'label-7'")
    + "select request_id, kafka_ts, route, session_id, cohort, left(prompt_text, 200) as prompt_preview, "
    "round(sim, 6) as similarity from ns order by sim desc, request_id limit 10",
)
def nearest_prompts(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest_prompts(W.scored_events(spark, d), W.one_query(spark, d, "label-7"), 10)
    return found.withColumn("similarity", r6("similarity"))


@query(
    "nearest_prompts_batch",
    "M-09 T-02",
    NEAREST_SQL.format(on="true")
    + "select query_id, cast(row_number() over (partition by query_id order by sim desc, request_id) as integer) as rank, "
    "request_id, round(sim, 6) as similarity from ns "
    "qualify row_number() over (partition by query_id order by sim desc, request_id) <= 10",
)
def nearest_prompts_batch(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest_prompts_batch(W.scored_events(spark, d), W.label_queries(spark, d), 10)
    return found.withColumn("similarity", r6("similarity"))


PROMPTS_SQL = (
    f"with {W.FRAMES}, pr as materialized (select request_id, route, body, cohort, event_ts, session_id from fr "
    "where frame_type = 'request_body' and regexp_matches(body, '[A-Za-z0-9_]')) "
)


def text_prompts(spark: SparkSession, d: str) -> DataFrame:
    """User turns as prompts with the vectors of the default encoder."""
    users = W.frames(spark, d).where((F.col("frame_type") == "request_body") & F.col("body").rlike("[A-Za-z0-9_]"))
    prompts = users.select("request_id", "route", "session_id", "cohort", "event_ts", F.col("body").alias("prompt_text"))
    return embed_text(prompts, "prompt_text", "prompt_embedding", "query")


@query(
    "searched_texts",
    "M-09 D-01 X-09",
    PROMPTS_SQL + "select request_id as query_id, cast(1 as integer) as rank, cast(1.0 as double) as similarity from pr",
)
def searched_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every stored text finds itself, or its equal, first."""
    prompts = text_prompts(spark, d)
    asked = prompts.select(F.col("request_id").alias("query_id"), F.col("prompt_text").alias("text"))
    found = neighbours.search_texts(prompts, asked, 1)
    return found.select("query_id", "rank", r6("similarity").alias("similarity"))


@query(
    "checked_texts",
    "M-16 D-01",
    PROMPTS_SQL + "select request_id, route, cast(1.0 as double) as similarity, true as memory_hit, body as prompt_text "
    "from pr where cohort = 'drift'",
)
def checked_texts(spark: SparkSession, d: str) -> DataFrame:
    """Remembered texts are recognised on every route."""
    prompts = text_prompts(spark, d)
    base = fitted(prompts, DetectorConfig(min_samples=2))
    drift = prompts.where(F.col("cohort") == "drift")
    known = drift.select(
        F.col("request_id").alias("source_request_id"), F.col("session_id").alias("source_session_id"),
        F.col("route").alias("source_route"), "prompt_text", F.col("prompt_embedding").alias("embedding"),
        F.lit(0.0).alias("distance"), F.col("event_ts").cast("timestamp").alias("added_at"),
    )
    checked = scoring.check_texts(drift.select("request_id", "route", "prompt_text"), base, known)
    return checked.select("request_id", "route", r6("similarity").alias("similarity"), "memory_hit", "prompt_text")


@query("approximate_search_recall", "M-10")
def approximate_search_recall(spark: SparkSession, d: str) -> DataFrame:
    turns, queries = W.scored_events(spark, d), W.label_queries(spark, d)
    exact = neighbours.nearest_prompts_batch(turns, queries, 10)
    near = neighbours.approx_nearest(turns, queries, 10)
    return neighbours.recall(near, exact).select("query_id", r6("recall").alias("recall"))


@query(
    "index_search",
    "M-10",
    "select count(*) filter (vec_id % 100 = 0) as n_queries, count(*) as stored, true as recall_reached, true as few_vectors_read, "
    "true as ranks_complete, true as signs_kept from embeddings",
)
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """A stored index, half of it added in batches of which one comes twice, against the exact search."""
    vectors = W.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("request_id"), F.col("embedding").alias("prompt_embedding"), F.col("vec_id").alias("n"))
    path = scratch_path(spark, "index")
    index = vector_index.build(vectors.where("n % 4 < 2"), path)
    index.add(vectors.where("n % 4 = 2"), "second")
    index.add(vectors.where("n % 4 = 3"), "third")
    index.add(vectors.where("n % 4 = 2"), "second")
    index = vector_index.load(spark, path)
    queries = vectors.where("n % 100 = 0").select(F.col("request_id").alias("query_id"), F.col("prompt_embedding").alias("vector"))
    opposite = queries.select("query_id", F.transform("vector", lambda x: -x).alias("vector"))
    exact = cut(neighbours.nearest_prompts_batch(vectors, queries, 10))
    found = cut(index.search(queries, 10))
    hit = neighbours.recall(found, exact).agg(F.avg("recall").alias("recall"))
    # The vector itself is the farthest from its opposite, so a search over all of an index's cells must go below zero.
    below = index.search(opposite, index.cost(queries).first()["stored"], probe=len(index.centroids)).agg((F.min("similarity") < -0.999).alias("signs_kept"))
    cost = index.cost(queries).agg(
        F.count(F.lit(1)).alias("n_queries"), F.max("stored").alias("stored"), (F.avg(F.col("vectors_read") / F.col("stored")) <= 0.05).alias("few_vectors_read")
    )
    complete = found.groupBy("query_id").count().agg((F.min("count") == 10).alias("ranks_complete"))
    return hit.select((F.col("recall") >= 0.95).alias("recall_reached")).join(cost).join(complete).join(below)


# ---- topics ---------------------------------------------------------------


@query("topic_clusters", "M-07 A-09")
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    return R.cluster_sizes(topics.topic_clusters(W.scored_events(spark, d)))


@query("prompt_projection", "M-08")
def prompt_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = topics.projections(W.scored_events(spark, d))
    return rows.select("request_id", r6("x").alias("x"), r6("y").alias("y"), "cluster_id", "cohort")


def neighbours_kept(places: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that are also among the 15 nearest in the plane.

    The plane is laid on a small cap of a sphere, where the order by angle is that by distance.
    """
    reach = places.agg(F.max(F.hypot(F.col("x"), F.col("y")))).first()[0]
    cap = F.array(F.col("x") * (0.1 / reach), F.col("y") * (0.1 / reach), F.lit(1.0))
    rows = places.select("request_id", cap.alias("prompt_embedding"))
    near = neighbours.nearest_prompts_batch(rows, rows.select(F.col("request_id").alias("query_id"), F.col("prompt_embedding").alias("vector")), 16)
    others = near.where("query_id <> request_id")
    return neighbours.recall(others, exact).agg(F.avg("recall")).first()[0]


@query("neighbour_layout", "M-08", "select count(*) as n, true as all_placed, true as twice_pca from embeddings")
def neighbour_layout(spark: SparkSession, d: str) -> DataFrame:
    """The graph layout keeps at least twice the neighbours that the main plane keeps."""
    rows = W.table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("request_id"), F.col("embedding").alias("prompt_embedding"), F.col("label").cast("string").alias("cohort")
    )
    flat, graph = cut(topics.project_2d(rows)), cut(topics.project_2d(rows, graph=True))
    asked = rows.select(F.col("request_id").alias("query_id"), F.col("prompt_embedding").alias("vector"))
    exact = cut(neighbours.nearest_prompts_batch(rows, asked, 16).where("query_id <> request_id"))
    better = neighbours_kept(graph, exact) >= 2 * neighbours_kept(flat, exact)
    placed = F.bool_and(F.col("x").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    return graph.agg(F.count(F.lit(1)).alias("n"), placed.alias("all_placed")).withColumn("twice_pca", F.lit(better))


@query(
    "topic_cluster_totals",
    "M-07 A-09",
    f"with {W.SCORED_EVENTS} select cohort, count(*) as n, true as labelled from se group by cohort",
)
def topic_cluster_totals(spark: SparkSession, d: str) -> DataFrame:
    """Every prompt is in one of the k clusters."""
    labelled = topics.topic_clusters(W.scored_events(spark, d))
    inside = F.bool_and(F.coalesce(F.col("cluster_id").between(0, 7), F.lit(False)))
    return labelled.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), inside.alias("labelled"))


@query(
    "projected_prompts",
    "J-01 M-08",
    f"with {W.SCORED_EVENTS} select request_id, session_id, route, left(prompt_text, 150) as prompt_preview, cohort, true as placed from se",
)
def projected_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Projected points joined back to their prompts."""
    turns = W.scored_events(spark, d)
    rows = joins.projections_with_events(topics.projections(turns), turns)
    placed = ~F.isnan("x") & ~F.isnan("y") & F.col("cluster_id").between(0, 7)
    return rows.select("request_id", "session_id", "route", "prompt_preview", "cohort", placed.alias("placed"))


# ---- reports on drift -----------------------------------------------------


def best_drift(spark: SparkSession, d: str) -> DataFrame:
    return merge.best_drift_events(scores(spark, d).drift.withColumn("_age", F.lit(0)), "_age")


@query(
    "anomaly_timeline",
    "M-19 T-03",
    f"with {Q.drift()} select session_id, cohort, route, round(distance, 6) as distance, round(threshold, 6) as threshold, "
    "turn_count, flagged_by, worst_event_ts, worst_prompt_text from dv",
)
def anomaly_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.anomaly_timeline(best_drift(spark, d))
    return rows.withColumns({"distance": r6("distance"), "threshold": r6("threshold")})


@query(
    "top_drift_events",
    "T-03",
    f"with {Q.drift()} select session_id, route, round(distance, 6) as distance, flagged_by from dv "
    "order by dv.distance desc, session_id limit 20",
)
def top_drift_events(spark: SparkSession, d: str) -> DataFrame:
    top = ordering.top_drift_events(best_drift(spark, d), 20)
    return top.select("session_id", "route", r6("distance").alias("distance"), "flagged_by")


@query(
    "default_session",
    "T-05",
    f"with {Q.drift()} select session_id from dv order by distance desc, session_id limit 1",
)
def default_session(spark: SparkSession, d: str) -> DataFrame:
    return ordering.default_session(best_drift(spark, d), ordering.list_sessions(W.scored_events(spark, d)))


@query(
    "session_options",
    "U-01 T-04",
    f"with {Q.drift()}, ls as (select distinct session_id from se order by session_id limit 2000) "
    "select session_id from ls union select session_id from (select session_id from dv order by distance desc, session_id limit 20)",
)
def session_options(spark: SparkSession, d: str) -> DataFrame:
    picked = ordering.top_drift_events(best_drift(spark, d), 20)
    return ordering.session_options(ordering.list_sessions(W.scored_events(spark, d)), picked)


@query(
    "session_flags",
    "J-06",
    f"with {Q.drift()} select s.session_id, d.session_id is not null as flagged, d.flagged_by, d.worst_request_id, "
    "round(d.distance, 6) as distance from (select distinct session_id from se) s left join dv d using (session_id)",
)
def session_flags(spark: SparkSession, d: str) -> DataFrame:
    sessions = filters.with_session(W.scored_events(spark, d)).select("session_id").distinct()
    rows = joins.flag_sessions(sessions, best_drift(spark, d))
    return rows.select("session_id", "flagged", "flagged_by", "worst_request_id", r6("distance").alias("distance"))


@query(
    "flagged_by_cohort",
    "A-10",
    f"with {Q.drift()} select cohort, count(*) as n from dv group by cohort",
)
def flagged_by_cohort(spark: SparkSession, d: str) -> DataFrame:
    return R.flagged_by_cohort(best_drift(spark, d))


@query(
    "detector_evaluation",
    "A-11",
    f"""with {Q.drift()} select s.cohort, count(*) as sessions, count(d.session_id) as flagged,
round(count(d.session_id) / count(*), 6) as flag_rate
from (select distinct session_id, cohort from se) s left join dv d using (session_id) group by s.cohort""",
)
def detector_evaluation(spark: SparkSession, d: str) -> DataFrame:
    rows = R.evaluate_detector(W.scored_events(spark, d), best_drift(spark, d))
    return rows.withColumn("flag_rate", r6("flag_rate"))


@query(
    "overview",
    "A-04",
    f"with {Q.drift()} select (select count(*) from se) as total_events, (select count(distinct session_id) from se) "
    "as total_sessions, (select count(*) from dv) as total_flagged, (select max(window_end) from bl) as last_baseline, "
    "(select max(worst_event_ts) from dv) as last_detection",
)
def overview(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    base = fitted(turns)
    found = scoring.score_sessions(turns, base, memory(turns)).drift.withColumn("_age", F.lit(0))
    # Clock times differ between runs, so event times stand in for them.
    drift = merge.best_drift_events(found, "_age").withColumn("detected_at", F.col("worst_event_ts"))
    row = R.summary_stats(turns, drift, base.routes.withColumn("computed_at", F.col("window_end")))
    return row.withColumns({"last_baseline": wall("last_baseline"), "last_detection": wall("last_detection")})


@query(
    "session_trend",
    "M-17 W-03 W-04 F-06",
    f"""with {Q.baseline()},
sr as (select session_id, min_by(route, {{'t': event_ts, 'r': request_id}}) as route from se group by session_id),
tr as (
  select s.session_id, s.request_id, s.event_ts, r.route, left(s.prompt_text, 80) as prompt_preview, s.prompt_embedding,
         row_number() over (partition by s.session_id order by s.event_ts, s.request_id) - 1 as turn_index
  from se s join sr r using (session_id)
)
select t.session_id, t.turn_index, t.request_id, t.event_ts, t.route, t.prompt_preview, round(b.threshold, 6) as threshold,
       round(min({Q.distance("t.prompt_embedding", "c")}), 6) as distance
from tr t join bl b on b.route = t.route join cl c on c.route = t.route
group by t.session_id, t.turn_index, t.request_id, t.event_ts, t.route, t.prompt_preview, b.threshold""",
)
def session_trend(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    trend = reports.session_trend(turns, fitted(turns))
    return trend.withColumns({"distance": r6("distance"), "threshold": r6("threshold")})


# ---- acceptance -----------------------------------------------------------


@query(
    "check_knn",
    "Q-05",
    NEAREST_SQL.format(on="q.query_id = 'label-1'")
    + "select 'nearest neighbours are plausible' as name, bool_and(sim > 0.5 and cohort = 'normal') as passed, "
    "'top cohort=' || max(cohort) as detail from (select * from ns order by sim desc, request_id limit 1)",
)
def check_knn(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_knn(W.scored_events(spark, d), W.one_query(spark, d, "label-1"))


@query(
    "check_drift_knn",
    "Q-06",
    NEAREST_SQL.format(on="q.query_id = 'label-8'")
    + "select 'drift is detectable by similarity' as name, count_if(cohort = 'drift') >= 6 as passed, "
    "cast(count_if(cohort = 'drift') as varchar) || '/10 are drift' as detail "
    "from (select * from ns order by sim desc, request_id limit 10)",
)
def check_drift_knn(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_drift_knn(W.scored_events(spark, d), W.one_query(spark, d, "label-8"))


@query(
    "check_detector",
    "Q-07",
    f"""with {Q.drift()} select 'a route has a baseline' as name, count(*) > 0 as passed, cast(count(*) as varchar) as detail from bl
union all select 'a session is flagged', count(*) > 0, cast(count(*) as varchar) from dv
union all select 'a flagged session is drift', count_if(cohort = 'drift') > 0, cast(count_if(cohort = 'drift') as varchar) from dv""",
)
def check_detector(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    base = fitted(turns)
    found = scoring.score_sessions(turns, base, memory(turns)).drift.withColumn("_age", F.lit(0))
    return quality.check_detector(base.routes, cut(merge.best_drift_events(found, "_age")))
