"""Exact n-gram Jaccard join by T-occurrence search.

Two texts with a similarity of at least J share at least T = ceil(J * n) of the n shingles of either. Of the
n lists of a query the T - L longest need no merging: a partner shows up at least L times in the n - T + L
short ones, and is then probed against its whole set (DivideSkip; L is at most ``1 + SLACK``). "Short" follows
a global order of shingles by a sketch of document frequencies over all documents; the sketch has a fixed size
and only steers speed, never the result. Before a pair is probed, parity sketches of both sets are compared: where
they differ in more bits than the sets may differ in shingles, the pair is out for certain.

Texts with equal shingle sets form one class and are joined once. A text that shares less than L of its short
lists with others is out. Lists are not expanded into all pairs: members are first probed against the smallest
id of each list; after that only ids that are still in different components are paired, and a pair not again for
each list it shares: a row names its text's ``BEFORE`` open lists before it, and of two rows that share one of those
the pair is made there.

Null and empty texts have an empty set and link with nothing. Repeated rows stay repeated. If different texts
share an id, they count as one document whose links follow one of them. Null ids are dropped. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semdrift.llm.components import components
from semdrift.llm.hashing import mix, shingles
from semdrift.scale import cut

SKETCH_BITS = 20
_CHUNKS = 64
# Short lists beyond the first n - T + 1; a partner shows up once more for each.
SLACK = 8
# Lists of a text that a row of an open list names, so that a pair is not made again for each list it shares.
BEFORE = 16
# Bits of the filter that keeps texts without any partner from being shuffled.
FILTER_BITS = 22
# Longs of a set's parity sketch: bit h mod 512 is flipped by each shingle h.
SKETCHES = [f"s{i}" for i in range(8)]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_levels(docs: DataFrame, width: int) -> np.ndarray:
    """Rank of the document frequency of each of ``2**SKETCH_BITS`` shingle buckets, counted over all documents."""
    size = 1 << (SKETCH_BITS - 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for value in batch["text"]:
                found = shingles(value.as_py(), width)
                if len(found):
                    np.add.at(total, _bucket(found), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([c.tobytes() for c in total.reshape(_CHUNKS, size)], pa.binary())], names=["chunk", "counts"])

    def add(key, rows):
        import pandas as pd

        total = np.zeros(size, np.int64)
        for c in rows["counts"]:
            total += np.frombuffer(c, np.uint32)
        return pd.DataFrame({"chunk": [key[0]], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    counted = docs.select("text").mapInArrow(count, "chunk int, counts binary")
    # Sums of a share of the partitions first, so that no task reads those of all.
    part = F.spark_partition_id() % 16
    partial = counted.withColumn("part", part).groupBy("chunk", "part").applyInPandas(add, "chunk int, counts binary")
    rows = sorted(partial.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect())
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.uint16)
    total = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
    counts, rank = np.unique(total, return_inverse=True)
    return (rank if len(counts) <= 1 << 16 else rank * ((1 << 16) - 1) // len(counts)).astype(np.uint16)


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _often(n: Column, percent: int) -> Column:
    """How often a partner of a set of ``n`` shows up in its short lists at least, whatever the partner's size."""
    smallest = F.ceil(n * percent / 100)
    return F.greatest(F.lit(1), F.least(F.lit(1 + SLACK), F.ceil(smallest * percent / 100)))


def _signatures(docs: DataFrame, width: int, percent: int, levels: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n, hi, lo, s0 .. s7, short): size, 128-bit key and parity sketch of each document's set; with
    ``levels`` its short lists."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, odd, short = [], [], [], [], []
            for value in batch["text"]:
                found = shingles(value.as_py(), width)
                n.append(len(found))
                hi.append(int(mix(found).sum(dtype=np.uint64)))
                lo.append(int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                flips = np.bincount((found & np.uint64(511)).astype(np.int64), minlength=512) & 1
                odd.append(np.packbits(flips.astype(np.uint8)).view(np.int64))
                if levels is not None:
                    t = _needed(len(found), percent)
                    k = len(found) - t + min(1 + SLACK, t)
                    short.append(found[np.argsort(levels[_bucket(found)], kind="stable")[:k]].view(np.int64))
            key = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hi, lo)]
            lists = pa.array(short, pa.list_(pa.int64())) if levels is not None else pa.nulls(len(n), pa.list_(pa.int64()))
            sketch = [pa.array(c, pa.int64()) for c in np.array(odd, np.int64).reshape(len(n), len(SKETCHES)).T]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), *key, *sketch, lists], names=["doc_id", "n", "hi", "lo", *SKETCHES, "short"])

    return docs.mapInArrow(sign, f"doc_id long, n long, hi long, lo long, {', '.join(c + ' long' for c in SKETCHES)}, short array<long>")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches of two aliased rows leave room for the similarity."""
    apart = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))).cast("long") for c in SKETCHES), F.lit(0))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (apart * (100 + percent) <= (n + m) * (100 - percent))


def _probe(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) that reach the similarity, as (a, b)."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.empty(0, np.uint64))
        for batch in batches:
            good = []
            for x, y in zip(batch["text_a"], batch["text_b"], strict=True):
                y = y.as_py()
                if y != last[0]:
                    last = (y, shingles(y, width))
                mine, other = shingles(x.as_py(), width), last[1]
                at = np.searchsorted(other, mine)
                shared = int((other[np.minimum(at, len(other) - 1)] == mine).sum())
                good.append(100 * shared >= percent * (len(mine) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(probe, "a long, b long")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``ids``. A bit table of fixed size, broadcast, lets few others be shuffled."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    one = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << FILTER_BITS}) & 63 as int))")
    words = ids.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(one).alias("bits"))
    keyed = docs.withColumn("id", F.col("doc_id"))
    keyed = keyed.withColumn("w", F.shiftright(place, 6)).join(F.broadcast(words), "w")
    likely = keyed.where(F.getbit("bits", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")) == 1)
    return likely.select("doc_id", "text").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))


def _open_pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a list of ``open_`` (tok, id, c, n, s0 .. s7) and may link.

    The first list that a pair shares always makes it: no earlier one is shared then. Few later ones do.
    """
    earlier = Window.partitionBy("id").orderBy("tok").rowsBetween(-BEFORE, -1)
    rows = open_.withColumn("before", F.collect_list("tok").over(earlier))
    x, y = rows.alias("x"), rows.alias("y")
    fresh = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.c") < F.col("y.c")) & _may_link("x", "y", percent) & ~F.arrays_overlap("x.before", "y.before")
    return x.join(y, fresh).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))


def _often_met(pairs: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` that share as many lists of ``open_`` as partners do."""
    lists = open_.groupBy("id").agg(F.collect_list("tok").alias("toks"), F.max("n").alias("n"))
    x, y = lists.alias("x"), lists.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
    shared = F.size(F.array_intersect("x.toks", "y.toks"))
    return both.where(shared >= _often(F.greatest("x.n", "y.n"), percent)).select("a", "b")


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, class_id, component_id), one for each row of ``docs`` with an id.

    ``class_id`` is the smallest id with the same set, ``component_id`` the smallest id reachable by links.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    # The sets are hashed anew for the short lists: that costs less than to keep the lists of all documents.
    signed = cut(_signatures(docs, width, percent).select("doc_id", "n", "hi", "lo", *SKETCHES))
    classes = signed.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("class_id"))
    members = signed.select("doc_id", "n", "hi", "lo").join(classes, ["hi", "lo", "n"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    members = cut(members)
    listed = _signatures(docs, width, percent, frequency_levels(docs, width)).where("n > 0")
    heads = listed.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("id"), F.first("short").alias("short"))
    # One exchange serves both sides of the join below.
    postings = heads.select("id", "n", F.explode("short").alias("tok")).repartition("tok")
    shared = postings.groupBy("tok").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("n").alias("least"))
    shared = shared.where("low < high and least > 0").select("tok")
    inside = F.count(F.lit(1)).over(Window.partitionBy("id"))
    active = postings.join(shared, "tok", "left_semi").withColumn("m", inside).where(F.col("m") >= _often(F.col("n"), percent))
    active = cut(active.select("tok", "id", "n"))
    hubs = active.groupBy("tok").agg(F.min("id").alias("hub"), F.max("id").alias("far")).where("hub < far").select("tok", "hub")
    met = active.join(hubs, "tok").where("id <> hub").groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    known = active.select("id").distinct()
    marks = signed.withColumnRenamed("doc_id", "id").join(known, "id", "left_semi").groupBy("id").agg(F.min(F.struct("n", *SKETCHES)).alias("m"))
    marks = cut(marks.select("id", "m.*"))
    met = met.where(F.col("c") >= _often(F.col("n"), percent)).select("a", "b")
    near = met.join(marks.alias("x"), F.col("a") == F.col("x.id")).join(marks.alias("y"), F.col("b") == F.col("y.id"))
    tried = cut(near.where(_may_link("x", "y", percent)).select("a", "b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = _texts_of(docs, pairs.select(F.col("a").alias("id"))).select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = _texts_of(docs, pairs.select(F.col("b").alias("id"))).select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return cut(_probe(both, width, percent))

    links = confirmed(tried)
    found = components(links)
    # Whatever is still apart within a list is paired, component against component.
    placed = active.join(found, "id", "left").select("tok", "id", F.coalesce("component_id", "id").alias("c"))
    split = placed.groupBy("tok").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("tok")
    open_ = cut(placed.join(split, "tok", "left_semi").join(marks, "id"))
    cross = _open_pairs(open_, percent).distinct().join(tried, ["a", "b"], "left_anti")
    cross = _often_met(cross, open_, percent)
    more = confirmed(cut(cross))
    final = components(links.union(more))
    return members.join(final, members["class_id"] == final["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component_id", "class_id").alias("component_id"))


def drop_jaccard_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked rows, one with the smallest id; rows with null ids come last.

    Every row is compared by a key of its own, so rows that repeat an id and rows without one are like any others.
    Rows without a shingle link with nothing and all stay.
    """
    # Stored first: the keys follow the partitions, which have to be the same whenever they are read.
    keyed = cut(docs.withColumn("__key", F.monotonically_increasing_id()))
    groups = jaccard_groups(keyed.select("__key", text), width, percent, "__key", text)
    members = groups.where("n_shingles > 0").select(F.col("doc_id").alias("__member"), F.col("component_id").alias("__group"))
    # Of each group only the first is not gone; groups of one are all first.
    shared = members.where("__member <> __group").select("__group").distinct()
    ranked = members.join(shared, "__group", "left_semi").join(keyed.select(F.col("__key").alias("__member"), F.col(id_col).alias("__id")), "__member")
    place = F.struct(F.col("__id").isNull().alias("none"), "__id", "__member")
    kept = ranked.groupBy("__group").agg(F.min(place).alias("p")).select(F.col("p.__member").alias("__member"))
    gone = ranked.select("__member").join(kept, "__member", "left_anti")
    return keyed.join(gone, F.col("__key") == F.col("__member"), "left_anti").drop("__key")
