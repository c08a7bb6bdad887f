"""Pieces of the SQL checks: windows, Lloyd rounds, distances, scores."""

from __future__ import annotations

from semdrift.checks.views import SCORED_EVENTS

# Rounds of the registered baseline queries, unrolled in the SQL text.
ROUNDS = 3

WINDOWS = SCORED_EVENTS + """,
win as (
  select route, min(event_ts) as window_start,
         make_timestamp(epoch_us(min(event_ts))
           + cast(floor((epoch_us(max(event_ts)) - epoch_us(min(event_ts))) * cast(0.5 as double)) as bigint)) as window_end
  from se group by route
),
samp as materialized (
  select s.route, s.request_id, s.event_ts, s.prompt_embedding as v
  from se s join win w on s.route = w.route and s.event_ts between w.window_start and w.window_end
)"""


def distance(v: str, c: str) -> str:
    """Diagonal Mahalanobis distance of list ``v`` to cluster row ``c``."""
    return (
        f"sqrt(list_sum(list_transform(list_zip({v}, {c}.centroid, {c}.variance), "
        "lambda z: (z[1] - z[2]) * (z[1] - z[2]) / (z[3] + cast(1e-6 as double)))))"
    )


def _stats(labels: str, digits: str) -> str:
    return f"""
  select route, cluster_id, cast(max(n) as integer) as sample_count,
         list(m order by pos) as centroid, list(s order by pos) as variance
  from (select route, cluster_id, pos, count(*) as n, {digits} as m, var_pop(v[pos]) as s
        from (select *, unnest(range(1, len(v) + 1)) as pos from {labels})
        group by route, cluster_id, pos)
  group by route, cluster_id"""


def _label(centroids: str) -> str:
    return f"""
  select s.route, s.request_id, s.v, c.cluster_id
  from samp s join {centroids} c on s.route = c.route
  qualify row_number() over (partition by s.route, s.request_id
                             order by list_distance(s.v, c.centroid), c.cluster_id) = 1"""


def baseline(rounds: int = ROUNDS, k: int = 4) -> str:
    """CTEs up to ``cl`` (clusters) and ``bl`` (routes)."""
    out = WINDOWS + f""",
sz as (
  select route, cast(count(*) as integer) as sample_count,
         cast(greatest(1, least({k}, count(*) // 30)) as integer) as k
  from samp group by route having count(*) >= 30
),
rk as (select route, request_id, row_number() over (partition by route order by md5(request_id), request_id) as rn
       from samp),
c0 as materialized (
  select s.route, cast(r.rn - 1 as integer) as cluster_id, s.v as centroid
  from rk r join sz on sz.route = r.route and r.rn <= sz.k join samp s on s.route = r.route and s.request_id = r.request_id
)"""
    for i in range(1, rounds + 1):
        out += f""",
l{i} as materialized ({_label(f"c{i - 1}")}),
c{i} as materialized ({_stats(f"l{i}", "round(avg(v[pos]), 12)")})"""
    return out + f""",
lf as materialized ({_label(f"c{rounds}")}),
cl as materialized ({_stats("lf", "avg(v[pos])")}),
sd as materialized (
  select s.route, s.request_id, min({distance("s.v", "c")}) as distance
  from samp s join cl c on s.route = c.route group by s.route, s.request_id
),
bl as materialized (
  select z.route, z.sample_count, n.n_clusters, t.threshold, w.window_start, w.window_end
  from sz z
  join (select route, cast(count(*) as integer) as n_clusters from cl group by route) n on n.route = z.route
  join (select route, avg(distance) + 2.0 * stddev_pop(distance) as threshold from sd group by route) t on t.route = z.route
  join win w on w.route = z.route
)"""


MEMORY = """,
mem as materialized (
  select s.request_id as source_request_id, s.session_id as source_session_id, s.route as source_route,
         s.prompt_text, s.prompt_embedding as embedding
  from se s join win w on s.route = w.route and s.cohort = 'drift' and s.event_ts <= w.window_end
),
dm as materialized (
  select embedding, min(source_request_id) as request_id, min_by(prompt_text, source_request_id) as prompt_text
  from mem group by embedding
)"""

# Nearest memory of each distinct vector of the events.
NEAREST = MEMORY + """,
nm as materialized (
  select v, max(sim) as similarity, min_by(request_id, {'s': -sim, 'r': request_id}) as matched_request_id,
         min_by(prompt_text, {'s': -sim, 'r': request_id}) as matched_text
  from (select d.v, m.request_id, m.prompt_text, round(list_cosine_similarity(d.v, m.embedding), 12) as sim
        from (select distinct prompt_embedding as v from se) d cross join dm m)
  group by v
)"""


def scored(rounds: int = ROUNDS) -> str:
    """CTEs up to ``st``: scored online turns."""
    return baseline(rounds) + NEAREST + f""",
od as materialized (
  select s.route, s.request_id, min({distance("s.prompt_embedding", "c")}) as distance,
         min_by(c.cluster_id, {{'d': {distance("s.prompt_embedding", "c")}, 'c': c.cluster_id}}) as cluster_id
  from se s join bl b on b.route = s.route and s.event_ts > b.window_end join cl c on c.route = s.route
  group by s.route, s.request_id
),
st as materialized (
  select s.request_id, s.session_id, s.route, s.event_ts, s.prompt_text, s.cohort, s.prompt_embedding, b.threshold,
         d.distance, d.cluster_id, n.similarity, n.matched_request_id, n.matched_text,
         d.distance > b.threshold as baseline_hit, coalesce(n.similarity >= 0.9, false) as memory_hit
  from se s join bl b on b.route = s.route and s.event_ts > b.window_end
  join od d on d.route = s.route and d.request_id = s.request_id
  left join nm n on n.v = s.prompt_embedding
)"""


def drift(rounds: int = ROUNDS) -> str:
    """CTEs up to ``de``: one drift row per flagged session and route, and ``dv``: one per session."""
    return scored(rounds) + """,
wt as (
  select * from st
  qualify row_number() over (partition by route, session_id order by distance desc, event_ts, request_id) = 1
),
mt as (
  select * from st where similarity >= 0.9
  qualify row_number() over (partition by route, session_id order by similarity desc, event_ts, request_id) = 1
),
tc as (select route, session_id, cast(count(*) as integer) as turn_count from st group by route, session_id),
de as materialized (
  select w.session_id, w.route,
         case when w.distance > w.threshold then w.request_id else m.request_id end as worst_request_id,
         case when w.distance > w.threshold then w.event_ts else m.event_ts end as worst_event_ts,
         case when w.distance > w.threshold then w.prompt_text else m.prompt_text end as worst_prompt_text,
         case when w.distance > w.threshold then w.cohort else m.cohort end as cohort,
         w.distance, w.threshold, c.turn_count,
         case when w.distance > w.threshold and m.request_id is not null then 'both'
              when w.distance > w.threshold then 'baseline' else 'memory' end as flagged_by
  from wt w join tc c on c.route = w.route and c.session_id = w.session_id
  left join mt m on m.route = w.route and m.session_id = w.session_id
  where w.distance > w.threshold or m.request_id is not null
),
dv as materialized (
  select * from de qualify row_number() over (partition by session_id order by distance desc, route) = 1
)"""
