import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semdrift.config import DetectorConfig
from semdrift.functions import vectors as V
from semdrift.operators import neighbours
from semdrift.operators import block_search
from semdrift.operators.block_search import BlockPlan, nearest_memory, with_text
from semdrift.plans import baseline as B

TURNS = "route string, request_id string, event_ts timestamp_ntz, prompt_embedding array<float>"


def random_turns(spark, n, dim=6, seed=1, routes=("a",)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(routes[i % len(routes)], f"r{i:05d}", [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "route string, request_id string, prompt_embedding array<float>"), x


def memory_table(spark, x, ids=None):
    ids = ids or [f"m{i:05d}" for i in range(len(x))]
    rows = [(i, f"text {i}", [float(v) for v in row]) for i, row in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, "source_request_id string, prompt_text string, embedding array<float>")


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(V.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, None, pytest.approx(1.0), None]


def test_mahalanobis_adds_epsilon_to_variance_and_hides_nan(spark):
    rows = [([1.0, 1.0], [0.0, 0.0], [0.0, 4.0]), ([float("nan"), 1.0], [0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "x array<double>, m array<double>, v array<double>")
    got = [r[0] for r in df.select(V.diag_mahalanobis(F.col("x"), F.col("m"), F.col("v"))).collect()]
    assert got[0] == pytest.approx(math.sqrt(1 / 1e-6 + 1 / (4 + 1e-6)))
    assert got[1] is None


def test_nearest_cluster_ties_empty_list_and_both_paths(spark):
    turns = spark.createDataFrame(
        [("a", "r1", [0.0, 0.0]), ("a", "r2", None), ("b", "r3", [1.0, 1.0]), ("a", "r4", [float("nan"), 0.0])],
        "route string, request_id string, prompt_embedding array<float>",
    )
    clusters = spark.createDataFrame(
        [("a", 1, [1.0, 0.0], [1.0, 1.0]), ("a", 0, [-1.0, 0.0], [1.0, 1.0]), ("a", 2, [5.0, 5.0], [1.0, 1.0])],
        "route string, cluster_id int, centroid array<double>, variance array<double>",
    )
    book = B.score_nearest(turns, clusters)
    joined = B.score_nearest(turns, clusters, DetectorConfig(cluster_book_bytes=0))
    for scored in (book, joined):
        got = {r["request_id"]: (r["distance"], r["cluster_id"]) for r in scored.collect()}
        assert got["r1"] == (pytest.approx(1.0, abs=1e-5), 0)  # equally near to 0 and 1
        assert got["r2"] == got["r3"] == got["r4"] == (None, None)
    empty = turns.where("request_id = 'r1'").withColumn("clusters", F.array().cast("array<struct<cluster_id:int,centroid:array<double>,variance:array<double>>>"))
    none = empty.select(V.nearest_in(F.col("prompt_embedding"), F.col("clusters")).alias("n")).first()["n"]
    assert (none["distance"], none["cluster_id"]) == (float("inf"), -1)


def test_effective_k(spark):
    df = spark.createDataFrame([(n,) for n in (0, 29, 30, 59, 60, 119, 120, 5000)], "n int")
    assert [r[0] for r in df.select(V.effective_k(F.col("n"), 4)).collect()] == [1, 1, 1, 1, 2, 3, 4, 4]


def test_moments_match_numpy_over_many_tasks(spark):
    df, x = random_turns(spark, 500, routes=("a", "b"))
    kernel = V.moments_kernel(lambda route, rows: (rows[:, 0] > 0).astype(int))
    parts = df.repartition(7).select("route", "prompt_embedding").mapInArrow(kernel, V.MOMENTS_SCHEMA)
    for r in V.merge_moments(parts).collect():
        rows = np.array([v for i, v in enumerate(x) if "ab"[i % 2] == r["route"] and int(v[0] > 0) == r["cluster_id"]])
        assert r["sample_count"] == len(rows)
        assert np.allclose(r["centroid"], rows.astype(float).mean(axis=0))
        assert np.allclose(r["variance"], rows.astype(float).var(axis=0))


def test_block_search_equals_brute_force(spark):
    turns, x = random_turns(spark, 400, seed=2)
    rng = np.random.default_rng(3)
    m = np.concatenate([x[:40], rng.normal(size=(260, 6)).astype(np.float32)])
    # A third of the memory and of the turns are copies of one vector.
    m = np.concatenate([m, np.repeat(m[:1], 150, axis=0)])
    copies = turns.where("request_id = 'r00000'").withColumn("request_id", F.explode(F.array_repeat(F.lit("copy"), 200)))
    turns = turns.unionByName(copies)
    memory = memory_table(spark, m)
    plan = BlockPlan(block_bytes=16 * 176, group_rows=20)
    got = nearest_memory(turns, memory, book_bytes=0, blocks=plan).collect()
    small = nearest_memory(turns, memory).collect()
    assert len(got) == len(small) == 600
    u, w = V.unit_rows(x.astype(float)), V.unit_rows(m.astype(float))
    best = (u @ w.T).max(axis=1)
    for r in got:
        want = best[0] if r["request_id"] == "copy" else best[int(r["request_id"][1:])]
        assert r["similarity"] == pytest.approx(want, abs=1e-9)
    # The size of the memory changes no row.
    key = lambda rows: sorted((r["request_id"], round(r["similarity"], 11), r["matched_request_id"]) for r in rows)
    assert key(got) == key(small)


@pytest.mark.parametrize("book_bytes", [1 << 20, 0])
def test_memory_search_compares_distinct_vectors_only(spark, monkeypatch, book_bytes):
    turns, x = random_turns(spark, 50, seed=6)
    turns = turns.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("request_id", F.concat_ws("-", "request_id", "n")).drop("n")
    asked = []
    for name in ("_search_book", "_search_blocks"):
        real = getattr(block_search, name)
        monkeypatch.setattr(block_search, name, lambda rows, *rest, real=real: (asked.append(rows.count()), real(rows, *rest))[1])
    found = nearest_memory(turns, memory_table(spark, x[:20]), book_bytes=book_bytes, blocks=BlockPlan(block_bytes=16 * 176, group_rows=7)).collect()
    assert asked == [50] and len(found) == 1500
    assert all(r["similarity"] == 1.0 for r in found if int(r["request_id"][1:6]) < 20)


def test_close_calls_are_settled_in_double():
    rng = np.random.default_rng(7)
    base = V.unit_rows(rng.normal(size=(30, 64)))
    # Differences far below single precision, with the best one last.
    memory = V.unit_rows(np.concatenate([base + s * rng.normal(size=base.shape) for s in (1e-8, 3e-9, 0.0, 0.0)]))
    x = V.unit_rows(np.concatenate([base, rng.normal(size=(40, 64)), np.full((1, 64), np.nan)]))
    top, at = block_search.best_rows(x, memory, memory.astype(np.float32))
    cosine = np.round(x[:-1] @ memory.T, 12)
    assert np.allclose(top[:-1], cosine.max(axis=1), rtol=0, atol=1.1e-12) and np.isnan(top[-1])
    assert (at[:30] == cosine[:30].argmax(axis=1)).mean() > 0.9
    assert (cosine[np.arange(70), at[:-1]] >= cosine.max(axis=1) - 1.1e-12).all()
    again, _ = block_search.best_rows(x, memory, memory.astype(np.float32), top + 0.1)
    assert np.isnan(again).all()


def test_variance_keeps_its_digits_far_from_zero(spark):
    rng = np.random.default_rng(8)
    x = 1e5 + rng.normal(size=(2000, 3)) * 1e-3
    rows = [("a", [float(v) for v in r]) for r in x]
    df = spark.createDataFrame(rows, "route string, prompt_embedding array<double>").repartition(9)
    parts = df.mapInArrow(V.moments_kernel(lambda route, v: np.zeros(len(v), int)), V.MOMENTS_SCHEMA)
    got = V.merge_moments(parts).first()
    assert got["sample_count"] == 2000
    assert np.allclose(got["variance"], x.var(axis=0), rtol=1e-6)
    assert np.allclose(got["centroid"], x.mean(axis=0), rtol=1e-14)


def test_mixed_lengths_are_refused():
    with pytest.raises(ValueError, match="different lengths"):
        V.as_matrix(pa.array([[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 5.0]]))


def test_infinite_distances_are_equal_both_ways(spark):
    inf, nan = float("inf"), float("nan")
    clusters = spark.createDataFrame(
        [("a", 0, [0.0, 0.0], [1.0, 1.0]), ("a", 1, [nan, 0.0], [1.0, 1.0]), ("b", 0, [nan, nan], [1.0, 1.0]),
         ("c", 0, [nan, 0.0], [1.0, 1.0]), ("c", 1, [inf, 0.0], [1.0, 1.0])],
        "route string, cluster_id int, centroid array<double>, variance array<double>",
    )
    vectors = [[1.0, 0.0], [inf, 0.0], [nan, 0.0], None]
    rows = [(r, f"{r}{i}", v) for r in "abcd" for i, v in enumerate(vectors)]
    turns = spark.createDataFrame(rows, "route string, request_id string, prompt_embedding array<double>")
    both = []
    for size in (1 << 20, 0):
        found = B.score_nearest(turns, clusters, DetectorConfig(cluster_book_bytes=size)).collect()
        both.append({r["request_id"]: (r["distance"], r["cluster_id"]) for r in found})
    assert both[0] == both[1]
    assert both[0]["a1"] == (inf, 0) and both[0]["c0"] == (inf, 1)
    assert all(both[0][k] == (None, None) for k in ("a2", "a3", "b0", "d0"))


def test_memory_edges(spark):
    turns = spark.createDataFrame(
        [("a", "r1", [1.0, 0.0]), ("a", "r2", None), ("a", "r3", [0.0, 0.0])],
        "route string, request_id string, prompt_embedding array<float>",
    )
    for memory in (memory_table(spark, []), memory_table(spark, [[0.0, 0.0]])):
        assert [r["similarity"] for r in nearest_memory(turns, memory).collect()] == [None, None, None]
    memory = memory_table(spark, [[2.0, 0.0], [4.0, 0.0]], ["m2", "m1"])
    found = {r["request_id"]: r for r in nearest_memory(turns, memory).collect()}
    assert (found["r1"]["similarity"], found["r1"]["matched_request_id"]) == (1.0, "m1")
    assert found["r2"]["similarity"] is None and found["r3"]["similarity"] is None
    told = {r["request_id"]: r["matched_text"] for r in with_text(nearest_memory(turns, memory), memory).collect()}
    assert told == {"r1": "text m1", "r2": None, "r3": None}
    blocked = {r["request_id"]: r for r in nearest_memory(turns, memory, book_bytes=0).collect()}
    assert blocked["r1"]["similarity"] == 1.0 and blocked["r3"]["similarity"] is None


def test_passes_share_the_vectors_of_the_events(spark, monkeypatch):
    """Ties, rows without a direction and more queries than a pass takes; the events' vectors are made once."""
    turns, x = random_turns(spark, 90, seed=9)
    turns = turns.unionByName(turns.withColumn("request_id", F.concat(F.lit("x"), "request_id")))
    turns = turns.unionByName(turns.limit(1).withColumns({"request_id": F.lit("zero"), "prompt_embedding": F.transform("prompt_embedding", lambda v: v * 0)}))
    queries = turns.select(F.col("request_id").alias("query_id"), F.col("prompt_embedding").alias("vector"))
    stored, real = [], neighbours.cut
    monkeypatch.setattr(neighbours, "cut", lambda df: (stored.append(df.columns), real(df))[1])
    got = neighbours.nearest_prompts_batch(turns, queries, 3, per_pass=50).collect()
    assert ["request_id", "prompt_embedding"] in stored
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["request_id"])
    u = V.unit_rows(x.astype(float))
    assert len(found) == 180
    for i in range(90):
        second = np.round(u[i] @ u.T, 12).argsort()[-2]
        assert found[f"r{i:05d}"] == found[f"xr{i:05d}"] == [f"r{i:05d}", f"xr{i:05d}", f"r{second:05d}"]


def test_batch_search_in_one_and_many_passes(spark):
    turns, x = random_turns(spark, 300, seed=4)
    queries, q = random_turns(spark, 9, seed=5)
    queries = queries.select(F.col("request_id").alias("query_id"), F.col("prompt_embedding").alias("vector"))
    sims = V.unit_rows(q.astype(float)) @ V.unit_rows(x.astype(float)).T
    want = {(f"r{i:05d}", rank + 1, f"r{j:05d}") for i in range(9) for rank, j in enumerate(np.argsort(-sims[i])[:5])}
    for per_pass in (100, 2):
        got = neighbours.nearest_prompts_batch(turns.repartition(5), queries, 5, per_pass).collect()
        assert {(r["query_id"], r["rank"], r["request_id"]) for r in got} == want


def test_batch_search_keeps_smallest_ids_of_copies(spark):
    rows = [("a", f"r{i:03d}", [1.0, 0.0]) for i in range(50)]
    turns = spark.createDataFrame(rows, "route string, request_id string, prompt_embedding array<float>").repartition(4)
    queries = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, vector array<float>")
    got = neighbours.nearest_prompts_batch(turns, queries, 3).collect()
    assert [r["request_id"] for r in sorted(got, key=lambda r: r["rank"])] == ["r000", "r001", "r002"]


def test_approximate_search_finds_copies(spark):
    turns, x = random_turns(spark, 200, seed=6)
    queries = turns.limit(5).select(F.col("request_id").alias("query_id"), F.col("prompt_embedding").alias("vector"))
    near = neighbours.approx_nearest(turns, queries, 3)
    first = {r["query_id"]: r for r in near.where("rank = 1").collect()}
    assert all(first[q]["request_id"] == q and first[q]["similarity"] == pytest.approx(1.0) for q in first)
    assert len(first) == 5
    exact = neighbours.nearest_prompts_batch(turns, queries, 3)
    assert neighbours.recall(near, exact).agg(F.avg("recall")).first()[0] >= 0.6
