import hashlib

import numpy as np
import pytest

from semdrift.config import DetectorConfig
from semdrift.functions.vectors import euclid_labels
from semdrift.plans import spread
from semdrift.plans.baseline import fit_route_clusters

SAMPLE = "route string, request_id string, prompt_embedding array<float>"
CFG = DetectorConfig(lloyd_rounds=20)


def blobs(rng, sizes, width=6, apart=8.0):
    centres = rng.normal(0, apart, (len(sizes), width))
    return np.vstack([c + rng.normal(0, 1, (n, width)) for c, n in zip(centres, sizes, strict=True)]).astype(np.float32)


def rows_of(route, x):
    """The lowest id hashes all belong to the first blob."""
    ids = sorted((f"{route}{i}" for i in range(len(x))), key=lambda s: hashlib.md5(s.encode()).hexdigest())
    return [(route, i, v.tolist()) for i, v in zip(ids, x, strict=True)]


def full_runs(x, k, runs=10):
    best = np.inf
    for seed in range(runs):
        c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].astype(float)
        for _ in range(100):
            label = euclid_labels(x, c)
            c = np.array([x[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(k)])
        best = min(best, float(((x - c[euclid_labels(x, c)]) ** 2).sum()))
    return best


@pytest.fixture(scope="module")
def routes():
    rng = np.random.default_rng(5)
    return {"/hot": blobs(rng, [900, 60, 40, 200]), "/b": blobs(rng, [40, 40, 40]), "/c": blobs(rng, [31])}


def test_inertia_near_the_best_of_full_runs(spark, routes, monkeypatch):
    monkeypatch.setattr(spread, "BATCH_ROWS", 300)
    sample = spark.createDataFrame([r for name, x in routes.items() for r in rows_of(name, x)], SAMPLE).repartition(6)
    ks = {"/hot": 4, "/b": 3, "/c": 1}
    sizes = spark.createDataFrame([(n, len(routes[n]), k) for n, k in ks.items()], "route string, sample_count int, k int")
    fitted = spread.fit_spread_clusters(sample, sizes, CFG)
    got = {r["route"]: r["inertia"] for r in spread.inertia(fitted).collect()}
    best = {n: full_runs(x, ks[n]) for n, x in routes.items()}
    assert all(got[n] <= 1.05 * best[n] for n in routes), (got, best)
    lowest = {r["route"]: r["inertia"] for r in spread.inertia(fit_route_clusters(sample, sizes, CFG, 3)).collect()}
    assert lowest["/hot"] > 1.5 * best["/hot"]
    counted = {n: sum(r["sample_count"] for r in fitted.collect() if r["route"] == n) for n in routes}
    assert counted == {n: len(x) for n, x in routes.items()}
    assert spread.SCANS < 1 + CFG.lloyd_rounds
    # Another order of rows, and a budget that holds one route at a time, give the same clusters.
    small = DetectorConfig(cluster_book_bytes=1)
    again = spread.fit_spread_clusters(sample.orderBy("request_id"), sizes, small)
    key = lambda df: [(r["route"], r["sample_count"], np.round(r["centroid"], 6).tolist()) for r in df.orderBy("route", "cluster_id").collect()]
    assert key(again) == key(fitted)


def test_few_and_equal_vectors_and_nulls(spark):
    same = [("/same", None, [1.0, 2.0])] * 40 + [("/same", "x", None)]
    two = [("/two", str(i), [float(i % 2), 0.0]) for i in range(60)]
    sample = spark.createDataFrame(same + two + [("/unasked", "u", [9.0, 9.0]), (None, "n", [5.0, 5.0])], SAMPLE)
    sizes = spark.createDataFrame([("/same", 40, 3), ("/two", 60, 4)], "route string, sample_count int, k int")
    rows = spread.fit_spread_clusters(sample, sizes, CFG).collect()
    got = sorted((r["route"], r["sample_count"], tuple(r["centroid"]), tuple(r["variance"])) for r in rows)
    assert got == [("/same", 40, (1.0, 2.0), (0.0, 0.0)), ("/two", 30, (0.0, 0.0), (0.0, 0.0)), ("/two", 30, (1.0, 0.0), (0.0, 0.0))]
    assert spread.fit_spread_clusters(sample.limit(0), sizes.limit(0), CFG).collect() == []
