import os
import uuid

import pytest
from pyspark.sql import functions as F

from semdrift.functions import encode
from semdrift.sources.vector_store import VectorStore

EVENTS = "id int, prompt_text string, completion_text string"


def counting_encoder(log, name=None):
    """Vectors of length and first letter; every encoded text and every load leave a line in ``log``."""

    def load():
        with open(f"{log}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")

        def run(texts):
            with open(f"{log}/texts-{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            return [[float(len(t)), float(ord(t[-1:] or "?"))] for t in texts]

        return run

    return encode.model_encoder(load, name=name)


def encoded(log):
    files = [f.read_text().split("\n") for f in log.iterdir() if f.name.startswith("texts-")]
    assert all(len(f) <= encode.MODEL_BATCH and [len(t) for t in f] == sorted(len(t) for t in f) for f in files)
    return sorted(t for f in files for t in f)


@pytest.fixture
def log(tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    return folder


def vectors(df):
    return {r["id"]: (r["prompt_embedding"], r["completion_embedding"]) for r in df.collect()}


def test_each_text_is_encoded_once(spark, tmp_path, log):
    hot = [(i, "hello", "hello" if i % 2 else None) for i in range(200)]
    rows = [*hot, *((300 + i, "a" * (i + 1), None) for i in range(70)), (900, None, None), (901, "", " ")]
    events = spark.createDataFrame(rows, EVENTS).withColumn("prompt_embedding", F.lit("clash")).repartition(5)
    store = VectorStore(str(tmp_path / "store"), "m1", counting_encoder(log))
    got = vectors(encode.embed_events(events, store))
    direct_log = tmp_path / "direct"
    direct_log.mkdir()
    assert len(got) == len(rows)
    want = vectors(encode.embed_events(events, counting_encoder(direct_log)))
    assert got == want and got[1][0] != got[1][1]
    first = encoded(log)
    assert len(first) == len(set(first)) == 71 + len({c for *_, c in rows if c and c != " "}) + 1
    # The same texts again, also after a rewrite: only a new one goes to the model.
    store.compact(spark)
    more = events.unionByName(spark.createDataFrame([(999, "new", None)], EVENTS).withColumn("prompt_embedding", F.lit("clash")))
    again = vectors(encode.embed_events(more, store))
    assert {k: v for k, v in again.items() if k != 999} == want
    assert len(encoded(log)) == len(first) + 1
    # Another model has vectors of its own.
    other = VectorStore(str(tmp_path / "store"), "m2", encode.model_encoder(lambda: lambda texts: [[7.0] for _ in texts]))
    assert vectors(encode.embed_events(events, other))[0][0] == [7.0]


def test_texts_stored_twice_are_read_once_and_empty_tables(spark, tmp_path, log):
    store = VectorStore(str(tmp_path / "store"), "m", counting_encoder(log, name=uuid.uuid4().hex))
    df = spark.createDataFrame([(1, "x" * 200_000), (2, "x" * 200_000), (3, None)], "id int, t string")
    assert store(df.limit(0), "t", "v").collect() == []
    assert [r["v"] for r in store(df.where("t is null"), "t", "v").collect()] == [None]
    store(df, "t", "v")
    store._store(df.where("id = 1").select(F.sha2("t", 256).alias("key"), F.col("t").alias("text")).withColumn("bucket", store._bucket("key")))
    assert store.stored(spark).count() == 2
    assert sorted((r["id"], r["v"]) for r in store(df, "t", "v").collect()) == [(1, [200_000.0, 120.0]), (2, [200_000.0, 120.0]), (3, None)]
    store.compact(spark)
    assert store.stored(spark).count() == 1
    loads = (log / "loads").read_text().split()
    assert len(loads) == len(set(loads))
