"""Prefix trie of conversations, built as a burst trie.

Turns are ids: two 64-bit hashes of role and text. A conversation's prefix of d turns is known by the running xor of
the hashes of (turn id, place), so every prefix is two longs, and equal conversations are merged into one class with
a weight before anything else; only one of them goes on. Classes lie in containers, below trie heads. A container
with more than ``container_turns`` turns still to go, of more than one class, bursts: its classes move on by their
next turn ids, and the node becomes a head. Bursts look 4, 8, 16, ... turns ahead in one aggregation, so the number of
rounds follows the logarithm of the depth of the heads. What does not burst is small: the suffixes of a container are
sorted and swept into nodes by one task. A container of one class is a chain and needs no task of its own, so a
conversation of any length is never held whole. Heads get their sums from aggregations over classes: a class owns the
nodes of which it is the smallest member, which are the last ones of its path, so each node is counted by one class.

Rows with a null id belong to no conversation and are left out. Null role or text is empty. Turns are ordered by
turn (null first), equal ones by role, then by the hash of the text; repeated rows are turns of their own. A
conversation may be left without turns by ``share_starts`` and then ends at the root. An empty table has no nodes.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semdrift.scale import cut, small_side

# A container with more turns to go bursts, so a container has at most twice as many turns and one.
CONTAINER_TURNS = 128
# Conversations up to this many turns are numbered in one task each.
GROUP_ROWS = 1_000_000
# Ids of one row on the way to the digest of a node.
IDS_PER_ROW = 2048
NO_IDS = hashlib.sha256(b"").hexdigest()

_NODE = "h1 long, h2 long, p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, before long, ends string"


# ---- turns -----------------------------------------------------------------


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], xors: dict[str, Column], group_rows: int) -> DataFrame:
    """Add running sums and running xors per ``key`` over this and all earlier rows.

    If a key has more than ``group_rows`` rows, rows are range-partitioned by key and order, and each task continues
    what the tasks before it hold of the key.
    """
    here = (Window.unboundedPreceding, Window.currentRow)
    kinds = {**{n: (F.sum, c, lambda a, b: a + b) for n, c in sums.items()}, **{n: (F.bit_xor, c, lambda a, b: a.bitwiseXOR(b)) for n, c in xors.items()}}
    largest = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if largest <= group_rows:
        window = Window.partitionBy(key).orderBy(*order).rowsBetween(*here)
        return df.withColumns({n: f(c).over(window) for n, (f, c, _) in kinds.items()})
    placed = cut(df.withColumns({f"_{n}": c for n, (_, c, _) in kinds.items()}).repartitionByRange(key, *order).withColumn("_task", F.spark_partition_id()))
    totals = placed.groupBy(key, "_task").agg(*[f(f"_{n}").alias(f"_{n}") for n, (f, _, _) in kinds.items()])
    earlier = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # A task continues at most one key, its first, so the start values are no more than the tasks.
    starts = totals.select(F.col(key).alias("_key"), F.col("_task").alias("_at"), *[f(f"_{n}").over(earlier).alias(f"_start_{n}") for n, (f, _, _) in kinds.items()])
    starts = F.broadcast(starts.where(F.col(f"_start_{next(iter(kinds))}").isNotNull()))
    window = Window.partitionBy(key, "_task").orderBy(*order).rowsBetween(*here)
    local = placed.withColumns({n: f(f"_{n}").over(window) for n, (f, _, _) in kinds.items()})
    joined = local.join(starts, (F.col(key) == F.col("_key")) & (F.col("_task") == F.col("_at")), "left")
    whole = {n: F.when(F.col("_key").isNull(), F.col(n)).otherwise(plus(F.col(n), F.col(f"_start_{n}"))) for n, (_, _, plus) in kinds.items()}
    return joined.withColumns(whole).select(*df.columns, *kinds)


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(conv_id, pos, k1, k2, size): the turns of each conversation from 1, their ids and code points."""
    said, by = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{role}`"), F.lit(""))
    turns = conversations.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), by.alias("role"), F.md5(said).alias("tie"),
        F.xxhash64(F.lit(1), by, said).alias("k1"), F.xxhash64(F.lit(2), by, said).alias("k2"), F.length(said).cast("long").alias("size"),
    ).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie"), F.col("k2")]
    return running(turns, "conv_id", order, {"pos": F.lit(1).cast("long")}, {}, group_rows).select("conv_id", "pos", "k1", "k2", "size")


def share_starts(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths (conv_id, n) of conversations rebuilt to share their starts.

    The first h = crc32(id) % ``most`` turns of conversation c come from conversation c - c % ``every``.
    """
    head = F.struct("pos", "k1", "k2", "size")
    starts = turns.where(F.col("pos") < most).groupBy(F.col("conv_id").alias("first")).agg(F.array_sort(F.collect_list(head)).alias("head"))
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumns(
        {"first": F.col("conv_id") - F.col("conv_id") % every, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most}
    )
    joined = lengths.join(starts, "first", "left")
    joined = cut(joined.withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast(starts.schema["head"].dataType))))
    taken = joined.select("conv_id", F.inline("head")).select("conv_id", "pos", "k1", "k2", "size")
    shift = joined.select("conv_id", "h", (F.size("head") - F.col("h")).alias("shift"))
    own = turns.join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "k1", "k2", "size")
    n = F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return taken.unionByName(own), joined.select("conv_id", n.cast("long").alias("n"))


# ---- classes of equal conversations ---------------------------------------------


def ends_digest(ids: DataFrame) -> DataFrame:
    """(h1, h2, ends): SHA-256 of the ascending, comma-joined ids per key.

    Ids are range-sorted over many tasks and joined to texts of ``IDS_PER_ROW``; one task then passes the texts of a
    key through the hash in order, holding one of them at a time.
    """

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, first = None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for h1, h2, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (h1, h2) or len(held) >= IDS_PER_ROW:
                    if held:
                        out.append((*key, first, ",".join(held)))
                    key, held, first = (h1, h2), [], conv
                held.append(str(conv))
            yield _batch(out, ["h1", "h2", "first", "ids"])
            out = []
        if held:
            yield _batch([(*key, first, ",".join(held))], ["h1", "h2", "first", "ids"])

    def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for h1, h2, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == (h1, h2):
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = (h1, h2), hashlib.sha256(ids.encode())
            yield _batch(out, ["h1", "h2", "ends"])
        if key is not None:
            yield _batch([(*key, state.hexdigest())], ["h1", "h2", "ends"])

    ranged = ids.select("h1", "h2", "conv_id").repartitionByRange("h1", "h2", "conv_id").sortWithinPartitions("h1", "h2", "conv_id")
    texts = ranged.mapInArrow(join_ids, "h1 long, h2 long, first long, ids string")
    return texts.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "first").mapInArrow(hash_ids, "h1 long, h2 long, ends string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"ids": pa.string(), "ends": pa.string()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names=names)


def paths(turns: DataFrame, lengths: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """The classes of equal conversations and the turns of their paths.

    Classes: (c, w, n, total, ends, t1, t2) with c the smallest member, w the members, total the code points.
    Paths: one row per class and depth from 1 to n, with the prefix's hashes h1, h2, its parent's p1, p2, the code
    points ``before`` and of the turn (``size``), and, at the end of the path, the digest ``ends``.
    """
    step = {"a1": F.xxhash64("k1", "pos"), "a2": F.xxhash64("k2", "pos")}
    rows = turns.select("conv_id", "pos", "size", *[c.alias(n) for n, c in step.items()])
    rows = cut(running(rows, "conv_id", [F.col("pos")], {"upto": F.col("size")}, {"h1": F.col("a1"), "h2": F.col("a2")}, group_rows))
    last = rows.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2", "upto")).alias("e"))
    last = last.select("conv_id", F.col("e.pos").alias("n"), "e.h1", "e.h2", F.col("e.upto").alias("total"))
    empty = lengths.where("n = 0").select("conv_id", "n", *[F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "total")])
    ids = cut(last.unionByName(empty))
    classes = ids.groupBy("h1", "h2").agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("w"), F.max("n").alias("n"), F.max("total").alias("total"))
    classes = cut(classes.join(ends_digest(ids), ["h1", "h2"]).select("c", "w", "n", "total", "ends"))
    along = rows.join(classes.withColumnRenamed("c", "conv_id"), "conv_id").select(
        F.col("conv_id").alias("c"), F.col("pos").alias("depth"), "h1", "h2",
        F.col("h1").bitwiseXOR(F.col("a1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("a2")).alias("p2"),
        "size", (F.col("upto") - F.col("size")).alias("before"), "w", "n", "total",
        F.when(F.col("pos") == F.col("n"), F.col("ends")).alias("ends"),
    )
    return classes, cut(along)


# ---- heads and containers ---------------------------------------------------------


def burst(along: DataFrame, container_turns: int) -> DataFrame:
    """(h1, h2, depth) of the nodes that are heads: more than one class and too many turns below."""
    heads, low, step = None, 0, 4
    while True:
        high = low + step
        level = along.where((F.col("depth") > low) & (F.col("depth") <= high))
        sized = level.groupBy("h1", "h2", "depth").agg(F.sum(F.col("n") - F.col("depth")).alias("below"), F.count(F.lit(1)).alias("classes"))
        found = cut(sized.where((F.col("below") > container_turns) & (F.col("classes") > 1)).select("h1", "h2", "depth"))
        heads = found if heads is None else heads.unionByName(found)
        if found.where(F.col("depth") == high).isEmpty():
            return heads
        low, step = high, 2 * step


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (container, class, depth) to nodes. One container at a time is held."""
    names = [f.split()[0] for f in _NODE.split(", ")]
    here, held = None, {}
    for batch in batches:
        out: list[tuple] = []
        cols = [c.to_pylist() for c in batch.columns]
        for k1, k2, c, depth, h1, h2, p1, p2, size, before, w, ends in zip(*cols, strict=True):
            if here != (k1, k2):
                out += _sweep_container(held)
                here, held = (k1, k2), {}
            held.setdefault(c, []).append((h1, h2, p1, p2, depth, size, before, w, ends))
        yield _batch(out, names)
    yield _batch(_sweep_container(held), names)


def _sweep_container(classes: dict[int, list[tuple]]) -> list[tuple]:
    """Suffixes in sorted order share what the one before them has on the stack."""
    nodes: list[list] = []
    stack: list[int] = []

    def pop() -> None:
        node = nodes[stack.pop()]
        if not node[2]:
            node[3] = 1
        node[4] += (node[1] - 1) * node[5][5]
        if stack:
            up = nodes[stack[-1]]
            up[0], up[1], up[2], up[3], up[4] = min(up[0], node[0]), up[1] + node[1], up[2] + 1, up[3] + node[3], up[4] + node[4]

    for c, path in sorted(classes.items(), key=lambda item: [t[:2] for t in item[1]]):
        shared = 0
        while shared < min(len(stack), len(path)) and nodes[stack[shared]][5][:2] == path[shared][:2]:
            shared += 1
        while len(stack) > shared:
            pop()
        for turn in path[shared:]:
            # smallest member, members, children, leaves, saved tokens, turn, digest, parent
            nodes.append([c, 0, 0, 0, 0, turn, None, stack[-1] if stack else None])
            stack.append(len(nodes) - 1)
        end = nodes[stack[-1]]
        end[0], end[1], end[6] = min(end[0], c), end[1] + path[-1][7], path[-1][8]
    while stack:
        pop()
    return [(*t[:5], low, None if up is None else nodes[up][0], count, children, leaves, saved, t[6], ends) for low, count, children, leaves, saved, t, ends, up in nodes]


def build_trie(turns: DataFrame, lengths: DataFrame, container_turns: int = CONTAINER_TURNS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per node: its hashes h1, h2 and those of its parent (p1, p2), depth, smallest member, that of the
    parent (the root has neither), members, children, leaves, tokens saved, and the digest of the conversations that
    end there (or null)."""
    classes, along = paths(turns, lengths, group_rows)
    heads = small_side(burst(along, container_turns).select("h1", "h2"))
    marked = along.join(heads.withColumn("head", F.lit(True)), ["h1", "h2"], "left")
    above = heads.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.lit(True).alias("below_head"))
    # The top of a container is no head and hangs below a head or the root.
    tops = marked.where("head is null").join(above, ["p1", "p2"], "left").where("below_head or depth = 1")
    tops = tops.select("c", F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("depth").alias("top"))
    sizes = tops.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("classes"))
    below = cut(marked.where("head is null").drop("head").join(tops.join(sizes, ["k1", "k2"]), "c"))

    columns = ["k1", "k2", "c", "depth", "h1", "h2", "p1", "p2", "size", "before", "w", "ends"]
    held = below.where("classes > 1").select(*columns).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "c", "depth")
    swept = held.mapInArrow(sweep, _NODE)
    chains = below.where("classes = 1").select(
        "h1", "h2", "p1", "p2", "depth", F.col("c").alias("conv_id"), F.when(F.col("depth") > F.col("top"), F.col("c")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"), "before", "ends",
    )
    return _with_heads(cut(swept.unionByName(chains)), classes, marked.where("head").drop("head"))


def _with_heads(low: DataFrame, classes: DataFrame, along: DataFrame) -> DataFrame:
    """Add the heads, whose sums are taken over the classes below them, and the root."""
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = classes.select(
        "c", zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), none.alias("p1"), none.alias("p2"), zero.alias("size"),
        zero.alias("before"), "w", "n", "total", F.when(F.col("n") == 0, F.col("ends")).alias("ends"),
    )
    members = cut(along.select(*root.columns).unionByName(root))
    key = ["h1", "h2", "depth"]
    first = cut(members.groupBy(*key).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("c").alias("conv_id"), F.sum("w").alias("n_convs"), F.max("before").alias("before"), F.max("ends").alias("ends")
    ))
    # From which depth on a class is the smallest member, and whether its path ends in a leaf.
    seen = first.select("conv_id", "depth", "before", F.lit(False).alias("leaf")).unionByName(low.select("conv_id", "depth", "before", (F.col("n_children") == 0).alias("leaf")))
    owns = seen.groupBy(F.col("conv_id").alias("c")).agg(F.min(F.struct("depth", "before")).alias("from"), F.max("leaf").alias("leaf"))
    # A root without turns below it is a leaf of its own.
    told = members.join(owns.select("c", F.col("from.depth").alias("since"), F.col("from.before").alias("since_before"), "leaf"), "c", "left")
    own = F.when(F.col("since").isNull(), 0).otherwise(F.col("total") - F.when(F.col("since") > F.col("depth"), F.col("since_before")).otherwise(F.col("before")))
    sums = told.groupBy(*key).agg(
        F.sum(((F.col("since") <= F.col("depth") + 1) & (F.col("n") > F.col("depth"))).cast("long")).alias("n_children"),
        F.sum(F.coalesce(F.col("leaf"), F.lit(False)).cast("long")).alias("n_leaves"),
        F.sum(F.col("w") * (F.col("total") - F.col("before")) - own).alias("saved_tokens"),
    )
    sums = sums.withColumn("n_children", F.coalesce("n_children", zero)).withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))
    upper = small_side(first.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id")))
    hung = low.where("parent_conv_id is null").drop("parent_conv_id").unionByName(first.join(sums, key))
    return low.where("parent_conv_id is not null").unionByName(hung.join(upper, ["p1", "p2"], "left").select(*low.columns))


def trie_digest(turns: DataFrame, lengths: DataFrame, container_turns: int = CONTAINER_TURNS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The nodes without their hashes."""
    return build_trie(turns, lengths, container_turns, group_rows).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"),
    )
