import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from semdrift.config import DetectorConfig
from semdrift.operators import merge
from semdrift.operators import rollups as R
from semdrift.plans import baseline as B
from semdrift.plans import scoring

T0 = dt.datetime(2024, 1, 1)
EVENTS = (
    "request_id string, session_id string, route string, event_ts timestamp_ntz, prompt_text string, cohort string, "
    "prompt_embedding array<float>, frame_type string"
)
MEMORY = (
    "source_request_id string, source_session_id string, source_route string, prompt_text string, "
    "embedding array<float>, distance double, added_at timestamp"
)


def minute(i):
    return T0 + dt.timedelta(minutes=i)


def traffic(spark, counts, dim=4, seed=0, scale=1.0):
    """Routes with ``counts`` turns each, one minute apart."""
    rng = np.random.default_rng(seed)
    rows = []
    for route, n in counts.items():
        for i in range(n):
            centre = (i % 2) * 5.0
            v = rng.normal(size=dim) * scale + centre
            rows.append((f"{route}-{i:04d}", f"{route}-s{i % 7}", route, minute(i), f"t{i}", "normal", v.tolist(), "request_body"))
    return spark.createDataFrame(rows, EVENTS)


def test_sample_size_limits(spark):
    # With n turns a minute apart, half the range holds n // 2 + n % 2 of them.
    events = traffic(spark, {"r29": 58, "r30": 60, "r59": 118, "r60": 120})
    base = B.compute_baselines(events, rounds=5)
    routes = {r["route"]: r for r in base.routes.collect()}
    assert {k: (v["sample_count"], v["n_clusters"]) for k, v in routes.items()} == {
        "r30": (30, 1), "r59": (59, 1), "r60": (60, 2),
    }
    assert routes["r60"]["window_start"] == T0
    assert routes["r60"]["window_end"] == minute(0) + dt.timedelta(minutes=119) / 2


def test_baseline_does_not_depend_on_layout_or_path(spark):
    events = traffic(spark, {"a": 400, "b": 150})
    cfg = DetectorConfig()
    runs = [
        B.compute_baselines(events, cfg),
        B.compute_baselines(events.repartition(5, "prompt_text"), cfg),
        B.compute_baselines(events, DetectorConfig(cluster_book_bytes=0, cache_sample=False)),
    ]
    seen = [
        (
            [(r["route"], r["cluster_id"], r["sample_count"], np.round(r["centroid"], 9).tolist())
             for r in run.clusters.orderBy("route", "cluster_id").collect()],
            [(r["route"], round(r["threshold"], 9)) for r in run.routes.orderBy("route").collect()],
        )
        for run in runs
    ]
    assert seen[0] == seen[1] == seen[2]
    assert sum(c[2] for c in seen[0][0]) == 200 + 75


def test_threshold_is_population_control_limit(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0)], "route string, distance double")
    d = np.array([1.0, 2.0, 6.0])
    assert R.route_threshold(df, 2.0).first()["threshold"] == pytest.approx(d.mean() + 2 * d.std())


def scored(spark, rows):
    schema = (
        "request_id string, session_id string, route string, event_ts timestamp_ntz, prompt_text string, cohort string, "
        "threshold double, distance double, similarity double"
    )
    full = [(i, s, "a", None if t is None else minute(t), i, "normal", 5.0, d, m) for i, s, t, d, m in rows]
    return spark.createDataFrame(full, schema)


def test_worst_turn_ties_and_triggers(spark):
    turns = scored(
        spark,
        [
            ("r3", "tie", 3, 7.0, None), ("r1", "tie", 1, 7.0, None), ("r2", "tie", None, 7.0, None),
            ("q1", "memory", 1, 4.0, 0.95), ("q2", "memory", 2, 4.5, 0.99), ("q3", "memory", 3, 4.5, 0.5),
            ("b1", "both", 1, 6.0, None), ("b2", "both", 2, 1.0, 0.9),
            ("n1", "none", 1, 5.0, 0.89), ("n2", "none", 2, None, None),
            ("z1", "nan", 1, None, 1.0),
        ],
    )
    got = {r["session_id"]: r for r in scoring.drift_events(turns).collect()}
    assert set(got) == {"tie", "memory", "both", "nan"}  # a distance equal to the threshold is no hit
    assert (got["tie"]["worst_request_id"], got["tie"]["flagged_by"], got["tie"]["turn_count"]) == ("r1", "baseline", 3)
    assert (got["memory"]["worst_request_id"], got["memory"]["flagged_by"]) == ("q2", "memory")
    assert got["memory"]["distance"] == 4.5
    assert (got["both"]["worst_request_id"], got["both"]["flagged_by"]) == ("b1", "both")
    assert (got["nan"]["worst_request_id"], got["nan"]["distance"]) == ("z1", -1.0)


def drift_table(spark, rows):
    return spark.createDataFrame(rows, "session_id string, route string, distance double, flagged_by string")


def test_drift_upsert_is_strict_and_idempotent(spark):
    old = drift_table(spark, [("s1", "a", 5.0, "baseline"), ("s2", "a", 5.0, "baseline"), ("s3", "a", 1.0, "memory")])
    new = drift_table(spark, [("s1", "a", 5.0, "both"), ("s2", "b", 6.0, "both"), ("s4", "a", 2.0, "memory"), ("s4", "b", 3.0, "both")])
    once = merge.upsert_drift_events(old, new)
    got = {r["session_id"]: (r["route"], r["distance"], r["flagged_by"]) for r in once.collect()}
    assert got == {
        "s1": ("a", 5.0, "baseline"), "s2": ("b", 6.0, "both"), "s3": ("a", 1.0, "memory"), "s4": ("b", 3.0, "both"),
    }
    twice = merge.upsert_drift_events(once, new)
    assert sorted(twice.collect()) == sorted(once.collect())


def test_memory_is_append_only(spark):
    schema = "source_request_id string, source_session_id string, source_route string, event_ts timestamp_ntz, distance double"
    old = spark.createDataFrame([("r1",)], "source_request_id string")
    hits = spark.createDataFrame(
        [
            ("r1", "s", "a", minute(1), 1.0), ("r2", "s", "a", minute(2), 2.0), ("r2", "s", "a", minute(1), 3.0),
            (None, "s", "a", minute(1), 9.0),
        ],
        schema,
    )
    got = merge.remember(old, hits).collect()
    assert [(r["source_request_id"], r["distance"]) for r in got] == [("r2", 3.0)]


def test_window_end_belongs_to_the_baseline_and_null_sessions_are_left_out(spark):
    events = traffic(spark, {"a": 121})
    extra = spark.createDataFrame(
        [("x1", None, "a", minute(200), "x", None, [99.0] * 4, "request_body")], EVENTS
    )
    base = B.compute_baselines(events, rounds=3)
    empty = spark.createDataFrame([], MEMORY)
    turns = scoring.score_turns(events.unionByName(extra), base, empty)
    assert turns.agg(F.min("event_ts"), F.count("*")).first()[:] == (minute(61), 60)


def test_transitive_memory_reaches_further_than_a_snapshot(spark):
    events = traffic(spark, {"a": 200}, scale=0.1)
    # y is far from the baseline; x repeats y in another scale, so only its direction matches.
    extra = spark.createDataFrame(
        [
            ("y", "sy", "a", minute(300), "y", "drift", [40.0, -40.0, 0.0, 0.0], "request_body"),
            ("x", "sx", "b", minute(300), "x", "drift", [4.0, -4.0, 0.0, 0.0], "request_body"),
        ],
        EVENTS,
    )
    other = traffic(spark, {"b": 200}, seed=9, scale=30.0)
    everything = events.unionByName(other).unionByName(extra)
    # The window must not move, so the baseline comes from the plain traffic.
    base = B.compute_baselines(events.unionByName(other), rounds=3)
    empty = spark.createDataFrame([], MEMORY)
    plain = scoring.score_sessions(everything, base, empty)
    chained = scoring.score_sessions(everything, base, empty, transitive=True)
    assert "sx" not in {r["session_id"] for r in plain.drift.collect()}
    flags = {r["session_id"]: r["flagged_by"] for r in chained.drift.collect()}
    assert flags["sx"] == "memory"
    assert {"x", "y"} <= {r["source_request_id"] for r in chained.memory.collect()}


def test_stored_baseline_reads_back(spark, tmp_path):
    from semdrift.sources.baselines import load_baseline

    base = B.compute_baselines(traffic(spark, {"a": 120, "b": 300}), rounds=2)
    base.write(str(tmp_path / "baseline"))
    rows = {r["route"]: r for r in load_baseline(spark, str(tmp_path / "baseline")).collect()}
    assert set(rows) == {"a", "b"}
    assert [c["cluster_id"] for c in rows["b"]["clusters"]] == sorted(c["cluster_id"] for c in rows["b"]["clusters"])


def test_check_prompts_gives_no_verdict_without_baseline(spark):
    base = B.compute_baselines(traffic(spark, {"/llm": 200}), rounds=2)
    prompts = spark.createDataFrame([("p1", [2.5] * 4)], "request_id string, prompt_embedding array<float>")
    memory = spark.createDataFrame([], MEMORY)
    assert scoring.check_prompts(prompts, base, memory).count() == 1
    assert scoring.check_prompts(prompts.withColumn("route", F.lit("/other")), base, memory).count() == 0


def test_stored_baselines_are_versions(spark, tmp_path):
    from semdrift.sources.baselines import load_baseline, stored_baseline

    path = str(tmp_path / "baseline")
    assert stored_baseline(spark, path) is None
    B.compute_baselines(traffic(spark, {"a": 200, "b": 200}), rounds=2).write(path)
    first = {r["route"]: r["sample_count"] for r in load_baseline(spark, path).collect()}
    # Route b has no data this time and keeps its rows.
    B.compute_baselines(traffic(spark, {"a": 100}), rounds=2).write(path)
    again = {r["route"]: r for r in load_baseline(spark, path).collect()}
    assert set(again) == {"a", "b"}
    assert again["b"]["sample_count"] == first["b"] and again["a"]["sample_count"] < first["a"]
    assert again["b"]["clusters"]


def test_streams_add_to_the_log_of_earlier_runs(spark, tmp_path):
    from semdrift.streaming import online

    base = B.compute_baselines(traffic(spark, {"a": 300}), rounds=2)
    turns = traffic(spark, {"a": 300})
    memory = spark.createDataFrame([], MEMORY)
    store, short = online.OnlineStore(str(tmp_path / "s")), online.OnlineStore(str(tmp_path / "c"))
    half = turns.where("pmod(xxhash64(request_id), 2) = 0"), turns.where("pmod(xxhash64(request_id), 2) = 1")
    for run, part in zip(("one", "two"), half, strict=True):
        for _ in range(2):  # a batch that runs twice counts once
            online.score_batch(part, 0, base, store, memory, run=run)
    whole = scoring.score_turns(turns, base, memory).groupBy("route", "session_id").count()
    want = {(r["route"], r["session_id"]): r["count"] for r in whole.collect()}
    online.compact(spark, store, short)
    for at in (store, short):
        log = spark.read.parquet(at.sessions).drop("batch", "part")
        got = {(r["route"], r["session_id"]): r["turn_count"] for r in online.merge_sessions(log).collect()}
        assert got == want
        drift = online.current_drift(spark.read.parquet(at.drift))
        assert drift.count() == drift.select("session_id").distinct().count()
    online.score_batch(half[0], 0, base, short, memory, run="three")
    assert online.run_name("/x/checkpoint") == online.run_name("/x/checkpoint") != online.run_name("/y")


def test_grown_memory_lists_no_pairs(spark):
    """What a loop over the turns finds, at a threshold that most pairs reach, in several parts and groups; no step
    hands out rows for all pairs."""
    from semdrift.operators.threshold_join import ThresholdPlan, known_matches

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(30, 3)).astype(np.float32).round(2) + 0.6
    rows = [(f"r{i:03d}", f"s{i % 3}", "a", minute(int(rng.integers(0, 60))), vectors[i % 30].tolist(), i % 41 == 7) for i in range(90)]
    schema = "request_id string, session_id string, route string, event_ts timestamp_ntz, prompt_embedding array<float>, baseline_hit boolean"
    empty = {"memory_hit": F.lit(False), "similarity": F.lit(None).cast("double"), "matched_request_id": F.lit(None).cast("string")}
    found = scoring.grown_memory(spark.createDataFrame(rows, schema).withColumns(empty), DetectorConfig(memory_threshold=0.3), ThresholdPlan(part_rows=9, group_rows=7))
    got = {r["request_id"]: (r["memory_hit"], None if r["similarity"] is None else round(r["similarity"], 9), r["matched_request_id"]) for r in found.collect()}
    unit = {r[0]: np.array(r[4], float) / np.linalg.norm(np.array(r[4], float)) for r in rows}
    kept, want = {}, {}
    for r in sorted(rows, key=lambda r: (r[3], r[2], r[1], r[0])):
        best = min(((-round(float(unit[r[0]] @ unit[m]), 12), m) for m in kept.values()), default=(9.0, None))
        hit = best[0] <= -0.3
        want[r[0]] = (hit, round(-best[0], 9) if hit else None, best[1] if hit else None)
        if (hit or r[5]) and tuple(r[4]) not in kept:
            kept[tuple(r[4])] = r[0]
    assert got == want
    ids = spark.range(400).select(F.col("id").cast("string").alias("a"), F.array(F.lit(1.0), F.col("id") / 400).alias("vector"))
    known = ids.select(F.col("a").alias("b"), "vector", F.struct(F.col("a").cast("int").alias("t"), F.col("a").alias("request_id")).alias("since"))
    assert known_matches(ids, known, 0.5, True, ThresholdPlan(part_rows=10_000)).count() == 400
    assert known_matches(ids, known, 0.5, False, ThresholdPlan(part_rows=10_000)).count() < 400 * 400 * 0.6
