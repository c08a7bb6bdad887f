"""Checks of relational operators over stored prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.checks import detection as D
from semdrift.checks import sqltext as Q
from semdrift.checks import views as W
from semdrift.checks.registry import query, r6, wall
from semdrift.functions import scalars as S
from semdrift.operators import filters, joins, merge, ordering
from semdrift.operators import rollups as R
from semdrift.plans import quality
from semdrift.plans.baseline import route_windows
from semdrift.scale import cut, scratch_path
from semdrift.streaming import online

CFG = D.CFG


@query(
    "events_scan",
    "S-03 F-01",
    f"with {W.SCORED_EVENTS} select request_id, route, session_id, event_ts from se where event_ts >= timestamp '2024-01-15'",
)
def events_scan(spark: SparkSession, d: str) -> DataFrame:
    late = filters.embedded_events(W.scored_events(spark, d)).where(F.col("event_ts") >= "2024-01-15")
    return late.select("request_id", "route", "session_id", "event_ts")


@query("distinct_routes", "A-01", f"with {W.SCORED_EVENTS} select distinct route from se")
def distinct_routes(spark: SparkSession, d: str) -> DataFrame:
    return R.distinct_routes(W.scored_events(spark, d))


@query("route_counts", "A-02", f"with {W.SCORED_EVENTS} select route, count(*) as n from se group by route")
def route_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.route_counts(W.scored_events(spark, d))


@query(
    "route_time_range",
    "A-03",
    f"with {W.SCORED_EVENTS} select route, min(event_ts) as first_ts, max(event_ts) as last_ts from se group by route",
)
def route_time_range(spark: SparkSession, d: str) -> DataFrame:
    return R.route_time_range(W.scored_events(spark, d))


@query("window_ends", "X-04", f"with {Q.WINDOWS} select route, window_end from win")
def window_ends(spark: SparkSession, d: str) -> DataFrame:
    return route_windows(W.scored_events(spark, d), 0.5).select("route", wall("window_end").alias("window_end"))


@query("baseline_window", "F-02", f"with {Q.WINDOWS} select route, request_id from samp")
def baseline_window(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    return filters.baseline_window(turns, D.windows(turns)).select("route", "request_id")


@query(
    "online_candidates",
    "F-03 F-07",
    f"with {Q.WINDOWS} select s.route, request_id from se s join win w on w.route = s.route and s.event_ts > w.window_end",
)
def online_candidates(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    rows = filters.online_candidates(filters.with_session(turns), D.windows(turns))
    return rows.select("route", "request_id")


@query(
    "late_rows",
    "R-05",
    f"with {Q.WINDOWS} select s.route, count(*) as n from se s join win w on w.route = s.route "
    "and s.kafka_ts > timestamp '2024-01-10' and s.event_ts <= w.window_end group by s.route",
)
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    since = F.lit("2024-01-10").cast("timestamp_ntz")
    return filters.late_rows(turns, D.windows(turns), since).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(
    "recent_prompts",
    "T-01",
    f"with {W.SCORED_EVENTS} select request_id, kafka_ts from se order by kafka_ts desc, kafka_offset desc limit 5000",
)
def recent_prompts(spark: SparkSession, d: str) -> DataFrame:
    return ordering.recent(W.scored_events(spark, d).select("request_id", "kafka_ts", "kafka_offset")).drop("kafka_offset")


@query(
    "session_list",
    "T-04",
    f"with {W.SCORED_EVENTS} select distinct session_id from se order by session_id limit 2000",
)
def session_list(spark: SparkSession, d: str) -> DataFrame:
    return ordering.list_sessions(W.scored_events(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Prompts as projected points: the label column of the vectors plays the cluster."""
    turns = W.scored_events(spark, d)
    first = F.col("prompt_embedding")
    return turns.withColumns(
        {
            "x": first[0].cast("double"),
            "y": first[1].cast("double"),
            "cluster_id": F.when(first[2] > 0, 1).otherwise(0) + F.when(first[3] > 0, 2).otherwise(0),
            "cohort": F.when(F.col("kafka_offset") % 10 != 0, F.col("cohort")),
        }
    )


POINTS = W.SCORED_EVENTS + """,
pt as (
  select request_id, prompt_embedding[1] as x, prompt_embedding[2] as y,
         case when prompt_embedding[3] > 0 then 1 else 0 end + case when prompt_embedding[4] > 0 then 2 else 0 end as cluster_id,
         case when kafka_offset % 10 <> 0 then cohort end as cohort
  from se
)"""


@query(
    "projections_with_events",
    "J-01",
    f"with {POINTS} select p.request_id, round(p.x, 6) as x, round(p.y, 6) as y, p.cluster_id, p.cohort, s.session_id, "
    "s.route, left(s.prompt_text, 150) as prompt_preview from pt p join se s using (request_id)",
)
def projections_with_events(spark: SparkSession, d: str) -> DataFrame:
    rows = joins.projections_with_events(labelled(spark, d), W.scored_events(spark, d))
    return rows.withColumns({"x": r6("x"), "y": r6("y")})


@query(
    "replaced_projections",
    "K-06",
    f"with {POINTS} select request_id, round(x, 6) as x, round(y, 6) as y, cluster_id, cohort from pt",
)
def replaced_projections(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "projections")
    points = labelled(spark, d).select("request_id", "x", "y", "cluster_id", "cohort")
    merge.replace_projections(points.withColumn("cluster_id", F.lit(-1)), path)
    merge.replace_projections(points, path)
    return spark.read.parquet(path).withColumns({"x": r6("x"), "y": r6("y")})


@query(
    "cluster_composition",
    "A-08",
    f"with {POINTS} select cluster_id, cast(count_if(cohort = 'drift') as bigint) as drift, cast(count_if(cohort = 'noise') as bigint) as noise, "
    "cast(count_if(cohort = 'normal') as bigint) as normal from pt where cohort is not null group by cluster_id",
)
def cluster_composition(spark: SparkSession, d: str) -> DataFrame:
    return R.cluster_composition(labelled(spark, d))


@query(
    "cluster_sizes",
    "A-09",
    f"with {POINTS} select cluster_id, cohort, count(*) as n, "
    "cast(sum(count(*)) over (partition by cluster_id) as bigint) as cluster_size from pt group by cluster_id, cohort",
)
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return R.cluster_sizes(labelled(spark, d))


@query(
    "flag_labels",
    "X-08",
    f"with {W.SCORED_EVENTS} select request_id, case when a and b then 'both' when a then 'baseline' when b then 'memory' end "
    "as flagged_by from (select request_id, kafka_offset % 2 = 0 as a, kafka_offset % 3 = 0 as b from se)",
)
def flag_labels(spark: SparkSession, d: str) -> DataFrame:
    offset = F.col("kafka_offset")
    return W.scored_events(spark, d).select(
        "request_id", S.flagged_by(offset % 2 == 0, offset % 3 == 0).alias("flagged_by")
    )


@query(
    "settled_counts",
    "R-04",
    f"""with {W.SCORED_EVENTS}, a as (select route, count(*) as n from se where event_ts < timestamp '2024-01-20' group by route),
b as (select route, count(*) as n from se group by route)
select 'unchanged' as look, bool_and(x.n = y.n) as settled from b x join b y using (route)
union all select 'grown', bool_and(coalesce(a.n = b.n, false)) from b left join a using (route)
union all select 'first', false union all select 'empty', false""",
)
def settled_counts(spark: SparkSession, d: str) -> DataFrame:
    turns = W.scored_events(spark, d)
    now = cut(R.route_counts(turns))
    then = cut(R.route_counts(turns.where(F.col("event_ts") < "2024-01-20")))
    none = now.where(F.lit(False))
    looks = {"unchanged": (now, now), "grown": (then, now), "first": (none, now), "empty": (now, none)}
    out = None
    for name, (before, current) in looks.items():
        row = quality.is_settled(before, current).select(F.lit(name).alias("look"), "settled")
        out = row if out is None else out.unionByName(row)
    return out


def online_store(spark: SparkSession, d: str) -> online.OnlineStore:
    """State left by scoring the prompts as a stream of three files."""
    turns = cut(W.scored_events(spark, d))
    base, memory = D.fitted(turns), D.memory(turns)
    path = scratch_path(spark, "turns")
    # Short row groups, so that many tasks share the one file of a batch.
    turns.repartitionByRange(3, "event_ts").write.option("parquet.block.size", 8 << 20).parquet(path)
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(path)
    store = online.OnlineStore(scratch_path(spark, "online"))
    run = online.run_online(
        stream, lambda: base, store, scratch_path(spark, "checkpoint"), memory, CFG, {"availableNow": True}
    )
    run.awaitTermination()
    return store


@query(
    "streamed_scoring",
    "R-03 R-06 M-12",
    f"with {Q.drift()} select w.route, w.session_id, w.request_id as worst_request_id, round(w.distance, 6) as distance, "
    "c.turn_count from wt w join tc c on c.route = w.route and c.session_id = w.session_id",
)
def streamed_scoring(spark: SparkSession, d: str) -> DataFrame:
    log = spark.read.parquet(online_store(spark, d).sessions).drop("batch", "part")
    return online.merge_sessions(log).select(
        "route", "session_id", F.col("worst.request_id").alias("worst_request_id"),
        r6("worst.distance").alias("distance"), "turn_count",
    )


@query("streamed_drift_events", "R-03 R-06 K-04 K-05")
def streamed_drift_events(spark: SparkSession, d: str) -> DataFrame:
    # Which turn is remembered first depends on the order of the files.
    rows = online.current_drift(spark.read.parquet(online_store(spark, d).drift))
    return rows.select("session_id", "route", r6("distance").alias("distance"), "flagged_by")
