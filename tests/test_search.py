"""The stored index, the threshold join and the growing memory against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from semdrift.config import DetectorConfig
from semdrift.operators import neighbours, threshold_join, vector_index
from semdrift.operators.threshold_join import ThresholdPlan
from semdrift.plans import scoring

ODD = [("none", None), ("empty", []), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), ("short", [1.0]), ("inf", [float("inf")] + [0.0] * 15)]


def clustered(rng, n, dim=16, centres=8, spread=0.35):
    base = rng.standard_normal((centres, dim))
    return base[rng.integers(centres, size=n)] + spread * rng.standard_normal((n, dim))


def vector_table(spark, x, odd=ODD):
    rows = [(f"r{i:04d}", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows + odd, "request_id string, prompt_embedding array<float>")


# ---- index ---------------------------------------------------------------------


def test_index_finds_what_the_exact_search_finds(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = clustered(rng, 1200)
    x[700:] = x[3]  # a third of the rows and more are copies
    table = vector_table(spark, x)
    cfg = vector_index.IndexConfig(part_rows=100, group_queries=7, sample_rows=500, refine=3)
    path = str(tmp_path / "index")
    index = vector_index.build(table.where("request_id < 'r0400'"), path, cfg)
    index.add(table.where("request_id >= 'r0400'"), "later")
    index.add(table.where("request_id >= 'r0400'"), "later")
    index = vector_index.load(spark, path, cfg)
    queries = table.where("request_id rlike '00$' or request_id in ('r0003', 'none', 'zero', 'short')").select(F.col("request_id").alias("query_id"), F.col("prompt_embedding").alias("vector"))
    usable = queries.where("query_id like 'r%'")
    found = index.search(queries, 10)
    exact = neighbours.nearest_prompts_batch(vector_table(spark, x, []), usable, 10)
    assert neighbours.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.95
    want = {(r["query_id"], r["request_id"]): r["similarity"] for r in exact.collect()}
    rows = found.collect()
    assert {r["query_id"] for r in rows} == {r["query_id"] for r in usable.collect()}
    assert all(abs(want[r["query_id"], r["request_id"]] - r["similarity"]) < 1e-9 for r in rows if (r["query_id"], r["request_id"]) in want)
    # Copies tie; the smallest ids win.
    copies = [r["request_id"] for r in rows if r["query_id"] == "r0003"]
    assert copies == ["r0003", *[f"r{i:04d}" for i in range(700, 709)]]
    cost = index.cost(usable).collect()
    assert all(r["vectors_read"] <= 30 and r["stored"] == 1200 for r in cost)


def test_index_goes_below_zero_and_takes_nothing(spark, tmp_path):
    rows = [(f"r{i}", [float(np.cos(i)), float(np.sin(i))]) for i in range(8)]
    table = spark.createDataFrame(rows, "request_id string, prompt_embedding array<float>")
    index = vector_index.build(table, str(tmp_path / "a"), vector_index.IndexConfig(cells=3))
    found = index.search(spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>"), 8, probe=3).collect()
    assert len(found) == 8 and min(r["similarity"] for r in found) < -0.9
    assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 9))
    empty = vector_index.build(table.limit(0), str(tmp_path / "b"))
    assert empty.search(spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")).collect() == []
    assert vector_index.load(spark, str(tmp_path / "b")).search(spark.createDataFrame([("q", [1.0])], "query_id string, vector array<double>")).collect() == []


def test_a_search_for_all_rows_ranks_only_when_asked(spark, tmp_path):
    """A search that cuts nothing compares all rows once, and its pairs are shuffled only for their ranks."""
    rng = np.random.default_rng(6)
    x = clustered(rng, 300)
    x[200:] = x[3]
    table = vector_table(spark, x)
    index = vector_index.build(table, str(tmp_path / "index"), vector_index.IndexConfig(part_rows=50, group_queries=7))
    queries = table.where("request_id like '%0' or request_id = 'zero'").select(F.col("request_id").alias("query_id"), F.col("prompt_embedding").cast("array<double>").alias("vector"))
    found = index.search(queries, 300, probe=len(index.centroids))
    lowest = found.groupBy().agg(F.min("similarity").alias("s"))
    assert "Window" not in lowest._jdf.queryExecution().executedPlan().toString()
    rows = {}
    for r in found.collect():
        rows.setdefault(r["query_id"], []).append((r["rank"], -r["similarity"], r["request_id"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(rows) == 30
    for name, got in rows.items():
        near = u @ u[int(name[1:])]
        assert [g[0] for g in sorted(got)] == list(range(1, 301)) and sorted(got) == sorted(got, key=lambda g: g[1:])
        assert all(abs(near[int(i[1:])] + s) < 1e-6 for _, s, i in got)
    assert abs(lowest.first()["s"] - (u @ u[::10].T).min()) < 1e-6
    # Fewer ranks, and queries that come twice, are cut as ever.
    assert index.search(queries, 299, probe=len(index.centroids)).count() == 30 * 299
    assert index.search(queries.union(queries), 300, probe=len(index.centroids)).count() == 30 * 300


def test_a_query_is_sent_once_to_a_part_of_many_cells(spark, tmp_path):
    x = np.random.default_rng(7).standard_normal((400, 16))
    table = vector_table(spark, x)
    index = vector_index.build(table, str(tmp_path / "index"), vector_index.IndexConfig(part_rows=100))
    queries = table.where("request_id like '%0'").select(F.col("request_id").alias("query_id"), F.col("prompt_embedding").alias("vector"))
    sizes = index._sizes()
    dealt = index._dealt(index.probes(queries), sizes, "codes", "code", "binary").where("side = 0").select("part", "id", "cells").collect()
    assert len(dealt) == len({(r["part"], r["id"]) for r in dealt}) <= 40 * 8 < 40 * index.probe
    assert sum(len(r["cells"]) for r in dealt) >= 40 * min(index.probe, len(sizes))


# ---- threshold join --------------------------------------------------------------


@pytest.mark.parametrize("threshold", [0.9, 0.6, -0.2])
def test_threshold_join_loses_no_pair(spark, threshold):
    rng = np.random.default_rng(2)
    x, y = clustered(rng, 150, spread=0.5), clustered(np.random.default_rng(3), 260, spread=0.5)
    y[:40] = x[:40]
    y[200:] = y[0]
    left = spark.createDataFrame([(f"a{i}", [float(v) for v in r]) for i, r in enumerate(x)] + [("none", None), ("zero", [0.0] * 16)], "a string, vector array<double>")
    right = spark.createDataFrame([(f"b{i}", [float(v) for v in r]) for i, r in enumerate(y)] + [("none", None), ("zero", [0.0] * 16)], "b string, vector array<double>")
    plan = ThresholdPlan(part_rows=20, group_rows=50, sample_rows=100)
    found = threshold_join.similar_pairs(left, right, threshold, plan).collect()
    u, w = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    want = {(f"a{i}", f"b{j}") for i, j in zip(*np.nonzero(np.round(u @ w.T, 12) >= threshold), strict=True)}
    pairs = [(r["a"], r["b"]) for r in found if r["b"]]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    if threshold == 0.9:
        assert sum(r["verified"] for r in found) < 0.5 * len(x) * len(y)


def test_a_vector_is_sent_once_to_a_part_of_many_cells(spark):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((60, 16)), rng.standard_normal((400, 16))
    left = spark.createDataFrame([(f"a{i}", [float(v) for v in r]) for i, r in enumerate(x)], "a string, vector array<double>")
    right = spark.createDataFrame([(f"b{i}", [float(v) for v in r]) for i, r in enumerate(y)], "b string, vector array<double>")
    found = threshold_join.similar_pairs(left, right, 0.3, ThresholdPlan(sample_rows=400), best=True)
    counts = [r for r in found.collect() if r["b"] is None]
    # One row of counts for each vector and part; without structure it meets nearly all cells.
    assert len(counts) == len({r["a"] for r in counts}) == 60
    assert sum(r["met"] for r in counts) > 0.5 * 60 * 400
    homes = threshold_join._homes({0: 30, 1: 30, 2: 250, 4: 50, 5: 60}, 100)
    assert homes == {0: (0, 1), 1: (0, 1), 2: (1, 3), 4: (4, 1), 5: (5, 1)}


def test_matches_equal_the_full_search(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 300, spread=0.3)
    x[250:] = x[1]
    turns = vector_table(spark, x)
    memory = vector_table(spark, x[:60] * 2.0, [o for o in ODD if o[0] in ("none", "zero")]).select(F.col("request_id").alias("source_request_id"), F.col("prompt_embedding").alias("embedding"))
    good = turns.where("request_id like 'r%'")
    got = {r["request_id"]: (r["similarity"], r["matched_request_id"]) for r in neighbours.memory_hits(good, memory, 0.9, ThresholdPlan(part_rows=16, group_rows=64)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(len(x)):
        s = np.round(u[i] @ u[:60].T, 9)
        best = s.max()
        if best >= 0.9:
            similarity, match = got[f"r{i:04d}"]
            assert abs(similarity - best) < 1e-6 and s[int(match[1:])] >= best - 1e-6
        elif best < 0.9 - 1e-6:
            assert f"r{i:04d}" not in got
    assert neighbours.memory_hits(good, memory.limit(0)).collect() == []


# ---- growing memory ----------------------------------------------------------------


def test_memory_grows_in_turn_order(spark):
    """A chain in which each turn is like the one before it only, in order, in reverse, and with ties in time."""
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    t0 = dt.datetime(2024, 1, 1)
    rng = random.Random(1)
    rows = []
    for k in range(6):  # 20 degrees apart: cosine 0.94 to the neighbour, 0.77 to the next but one
        rows.append((f"up{k}", "s1", "a", t0 + dt.timedelta(minutes=k), at(20 * k), k == 0))
        rows.append((f"down{k}", "s2", "b", t0 + dt.timedelta(minutes=200 - k), at(180 + 20 * k), k == 0))
        rows.append((f"tie{k}", "s3", "c", t0 + dt.timedelta(minutes=500), at(20 * k + 5), False))
    rows += [("again", "s0", "a", t0 + dt.timedelta(minutes=900), at(180 + 60), False), ("early", "s0", "a", t0 - dt.timedelta(minutes=1), at(0), False)]
    rng.shuffle(rows)
    none = {"memory_hit": F.lit(False), "similarity": F.lit(None).cast("double"), "matched_request_id": F.lit(None).cast("string")}
    turns = spark.createDataFrame(rows, "request_id string, session_id string, route string, event_ts timestamp, prompt_embedding array<float>, baseline_hit boolean").withColumns(none)
    got = {r["request_id"]: r for r in scoring.grown_memory(turns, DetectorConfig()).collect()}
    order = sorted(rows, key=lambda r: (r[3], r[2], r[1], r[0]))
    remembered, want = [], {}
    for r in order:
        near = [(float(np.dot(r[4], m[4])), m[0]) for m in remembered if np.dot(r[4], m[4]) >= 0.9]
        want[r[0]] = max(near)[0] if near else None
        if r[5] or near:
            remembered.append(r)
    assert len(got) == len(rows)
    for name, similarity in want.items():
        assert got[name]["memory_hit"] is (similarity is not None), name
        assert similarity is None or abs(got[name]["similarity"] - similarity) < 1e-6
    assert [want[f"up{k}"] is not None for k in range(6)] == [False, True, True, True, True, True]
    assert not any(got[f"down{k}"]["memory_hit"] for k in range(1, 6)) and not got["early"]["memory_hit"]
    place = {r[0]: i for i, r in enumerate(order)}
    assert all(place[r["matched_request_id"]] < place[n] for n, r in got.items() if r["memory_hit"])


def test_no_hits_and_no_turns(spark):
    schema = "request_id string, session_id string, route string, event_ts timestamp, prompt_embedding array<float>, baseline_hit boolean, memory_hit boolean, similarity double, matched_request_id string"
    assert scoring.grown_memory(spark.createDataFrame([], schema)).collect() == []
    one = spark.createDataFrame([("x", "s", "a", dt.datetime(2024, 1, 1), [1.0, 0.0], False, False, None, None)], schema)
    assert [r["memory_hit"] for r in scoring.grown_memory(one).collect()] == [False]
