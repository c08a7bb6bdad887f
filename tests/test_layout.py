"""The neighbour graph and its layout on clusters, with one and with several blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semdrift.plans import layout


def points(spark, n=420, dim=12, centres=7):
    rng = np.random.default_rng(6)
    which = rng.integers(centres, size=n)
    x = rng.standard_normal((centres, dim))[which] * 2 + 0.5 * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True), which, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>").repartition(5)


def test_neighbour_descent_finds_the_nearest(spark, monkeypatch):
    x, _, df = points(spark)
    similarity = x @ x.T
    np.fill_diagonal(similarity, -2)
    want = np.argsort(-similarity, axis=1)[:, :10]
    got = {}
    for r in layout.neighbour_graph(df, 10).collect():
        got.setdefault(r["u"], []).append((r["v"], r["similarity"]))
    assert all(len(v) == 10 for v in got.values())
    assert np.mean([len({v for v, _ in got[i]} & set(want[i].tolist())) / 10 for i in range(len(x))]) > 0.97
    weights = layout.fuzzy_edges(layout.neighbour_graph(df, 10)).collect()
    both = {(r["u"], r["v"]): r["weight"] for r in weights}
    assert all(0 < w <= 1 + 1e-9 and abs(w - both[v, u]) < 1e-9 for (u, v), w in both.items())


@pytest.mark.parametrize("block", [2000, 100])
def test_layout_keeps_clusters_together(spark, monkeypatch, block):
    monkeypatch.setattr(layout, "BLOCK_POINTS", block)
    x, which, df = points(spark)
    start = df.select("id", F.element_at("vector", 1).alias("x"), F.element_at("vector", 2).alias("y"))
    rows = sorted(layout.neighbour_layout(df, start, rounds=6, epochs=30).collect())
    place = np.array([[r["x"], r["y"]] for r in rows])
    assert [r["id"] for r in rows] == list(range(len(x))) and np.isfinite(place).all()
    gap = ((place[:, None] - place[None]) ** 2).sum(axis=2)
    np.fill_diagonal(gap, np.inf)
    near = np.argsort(gap, axis=1)[:, :10]
    assert (which[near] == which[:, None]).mean() > 0.9
    assert [tuple(r) for r in sorted(layout.neighbour_layout(df, start, rounds=6, epochs=30).collect())] == [tuple(r) for r in rows]


def test_pairs_below_the_least_are_not_handed_on():
    """A group hands on what may be among a point's k best; a point without k neighbours hands on its k best of the group."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 8))
    centre = np.repeat([3, 5, 9], [12, 10, 8])
    ids = np.concatenate([np.sort(rng.choice(30, n, replace=False)) for n in (12, 10, 8)])
    least = [None if i % 7 == 0 else 0.2 + 0.01 * i for i in range(30)]
    rows = [pa.array(centre), pa.array(ids), pa.array(x[ids].tolist(), pa.list_(pa.float64())), pa.array([least[i] for i in ids], pa.float64())]
    whole = pa.RecordBatch.from_arrays(rows, names=["centre", "id", "vector", "least"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for c in (3, 5, 9):
        here = ids[centre == c]
        for u in here:
            near = sorted(((round(float(unit[u] @ unit[v]), 9), -v) for v in here if v != u), reverse=True)[:4]
            want |= {(u, -v, s) for s, v in near if least[u] is None or s >= least[u]}
    assert 0 < len(want) < 4 * len(ids)
    for batches in ([whole], [whole.slice(0, 7), whole.slice(7, 9), whole.slice(16)]):
        got = [tuple(r.values()) for b in layout._compare_groups(4)(iter(batches)) for r in b.to_pylist()]
        assert {(u, v, round(s, 9)) for u, v, s in got} == want


def test_weights_are_those_of_each_point_alone(spark):
    """Points of as many neighbours are weighed together."""
    rng = np.random.default_rng(3)
    rows = [(u, u + 1 + j, float(s)) for u in range(40) for j, s in enumerate(rng.uniform(-0.2, 1, size=1 + u % 9))]
    one_way = {}
    for u in range(40):
        gap = np.array([1 - s for a, _, s in rows if a == u])
        gap = gap - gap.min()
        low, high = 1e-6, 8.0
        for _ in range(40):
            width = (low + high) / 2
            low, high = (width, high) if np.exp(-gap / width).sum() < np.log2(len(gap) + 1) else (low, width)
        one_way |= {(u, v): w for (_, v, _), w in zip([r for r in rows if r[0] == u], np.exp(-gap / high), strict=True)}
    got = {(r["u"], r["v"]): r["weight"] for r in layout.fuzzy_edges(spark.createDataFrame(rows, "u long, v long, similarity double")).collect()}
    for u, v in got:
        a, b = one_way.get((u, v), 0.0), one_way.get((v, u), 0.0)
        assert got[u, v] == pytest.approx(a + b - a * b, abs=1e-12)
    assert {p for p in got if p[0] < p[1]} == one_way.keys()
