"""The search of many queries by cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from semdrift.functions.vectors import unit_rows
from semdrift.operators import cell_search, neighbours
from semdrift.operators.cell_search import CellPlan

SMALL = CellPlan(max_cells=12, sample_rows=150, part_rows=60, group_rows=40)


def table(spark, x, ids, kind="float"):
    rows = [(i, None if v is None else [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, f"request_id string, prompt_embedding array<{kind}>").repartition(3)


def brute(x, ids, q, k):
    """Per query the (id, similarity) of the k best, of equals the smallest ids."""
    s = np.round(np.einsum("qd,ed->qe", unit_rows(q), unit_rows(x)), 12)
    out = []
    for row in s:
        good = [j for j in range(len(ids)) if np.isfinite(row[j])]
        out.append([(ids[j], row[j]) for j in sorted(good, key=lambda j, row=row: (-row[j], ids[j]))[:k]])
    return out


def searched(spark, events, queries, count, k, plan):
    found = {}
    for r in cell_search.nearest(events.withColumnRenamed("prompt_embedding", "vector"), queries, count, k, plan).collect():
        found.setdefault(r["query_id"], []).append((r["request_id"], r["similarity"]))
    return {q: sorted(rows, key=lambda r: (-r[1], r[0]))[:k] for q, rows in found.items()}


def same(got, want):
    assert len(got) == len(want) and [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 2e-12 for (_, a), (_, b) in zip(got, want, strict=True))


def made(shape):
    rng = np.random.default_rng(5)
    if shape == "random":  # no structure: every vector meets every other
        return rng.standard_normal((500, 24))
    if shape == "plane":  # a cap of a sphere, as a layout is searched
        at = np.concatenate([rng.normal(0, 0.02, (400, 2)), rng.normal(0.08, 1e-4, (100, 2))])
        return np.concatenate([at, np.ones((500, 1))], axis=1)
    x = rng.standard_normal((8, 40))[rng.integers(8, size=500)] + 0.2 * rng.standard_normal((500, 40))
    x[300:420] = x[3]  # one vector that is everywhere, and copies of other lengths
    x[420:440] = 3 * x[:20]
    return x


@pytest.mark.parametrize("k", [1, 7])
@pytest.mark.parametrize("shape", ["random", "plane", "copies"])
def test_cells_find_what_brute_force_finds(spark, shape, k):
    x, rng = made(shape), np.random.default_rng(8)
    ids = [f"r{i:03d}" for i in rng.permutation(len(x))]
    events = table(spark, x, ids, "double")
    queries = events.select(F.col("request_id").alias("query_id"), F.col("prompt_embedding").alias("vector"))
    want = dict(zip(ids, brute(x, ids, x, k), strict=True))
    got = searched(spark, events, queries, len(x), k, SMALL)
    assert got.keys() == want.keys()
    for q in want:
        same(got[q], want[q])


def test_other_queries_repeated_ids_and_odd_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((200, 20))
    x[150:] = x[:50]  # the copies' ids repeat those of others
    ids = [f"r{i % 120:03d}" for i in range(200)]
    odd = [None, [0.0] * 20, [float("nan")] * 20, [float("inf")] + [0.0] * 19]
    events = table(spark, [*x, *odd, [1e200] * 20], [*ids, "none", "zero", "nan", "inf", "huge"], "double")
    q = np.concatenate([rng.standard_normal((60, 20)), x[:30], -x[:10]])
    names = [f"q{i % 90:02d}" for i in range(100)]  # some ids ask twice
    queries = spark.createDataFrame([(n, [float(c) for c in v]) for n, v in zip(names, q, strict=True)] + [("none", None), ("zero", [0.0] * 20), ("huge", [1e200] * 20)], "query_id string, vector array<double>")
    got = searched(spark, events, queries, 103, 9, SMALL)
    # A length that fits no double makes a vector that is as near to all.
    both, all_ids = np.concatenate([unit_rows(x), np.zeros((1, 20))]), [*ids, "huge"]
    pooled = {}
    for name, rows in zip([*names, "huge"], [[(i, s) for i, s in zip(all_ids, np.round(both @ v, 12), strict=True)] for v in np.concatenate([unit_rows(q), np.zeros((1, 20))])], strict=True):
        pooled.setdefault(name, []).extend(rows)
    assert got.keys() == pooled.keys()
    for name, rows in pooled.items():
        same(got[name], sorted(rows, key=lambda r: (-r[1], r[0]))[:9])


def test_no_events_and_fewer_than_k(spark):
    events = table(spark, [[1.0, 0.0], [0.0, 2.0], [0.0, 0.0]], ["a", "b", "z"])
    queries = spark.createDataFrame([("p", [0.5, 0.1]), ("q", [0.0, 1.0])], "query_id string, vector array<double>")
    assert searched(spark, events, queries, 2, 5, SMALL) == {"p": [("a", round(0.5 / 0.26**0.5, 12)), ("b", round(0.1 / 0.26**0.5, 12))], "q": [("b", 1.0), ("a", 0.0)]}
    for none in (events.limit(0), events.where("request_id = 'z'")):
        assert searched(spark, none, queries, 2, 5, SMALL) == {}
        assert neighbours.nearest_prompts_batch(none, queries, 5, per_pass=1).collect() == []


def test_queries_that_find_themselves_meet_few_vectors():
    """The pairs compared grow with the cells, not with the square of the vectors."""
    counts = {}
    for n in (500, 2000):
        x = np.random.default_rng(3).standard_normal((n, 32))
        unit = unit_rows(x)
        centres = cell_search._cells(unit, round(n**0.5), 8)
        cell = (unit @ centres.T).argmax(axis=1)
        dots = unit @ centres.T
        gram = centres @ centres.T
        low = np.array([dots[cell == c, c].min() if (cell == c).any() else 1.0 for c in range(len(centres))])
        star = dots.max(axis=1)
        seen = cell_search._open(dots, star, np.maximum(2 - 2 * gram[cell], 0), low - cell_search.SLACK, np.ones(n))
        assert seen[np.arange(n), cell].all()
        counts[n] = float((seen * np.bincount(cell, minlength=len(centres))).sum())
        assert counts[n] < 4 * n**1.5
    assert counts[2000] < 12 * counts[500]
