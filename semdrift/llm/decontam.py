"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose figures or names were exchanged has
the same template. Windows of ``WINDOW`` template words are hashed and joined with those of the benchmark.
Pairs that share enough windows at one offset are aligned, and their slots compared: a value of the item must
always stand for the same value of the document, or the match is chance and not a re-parameterised copy.

Everything on this path is SQL functions. Null and empty texts, and items of fewer than ``WINDOW`` template
words, match nothing. For ``leaks`` rows with equal ids count as one document and rows with null ids are left out;
``drop_leaks`` judges every row by itself. Empty tables give empty results. Extra columns are ignored by ``leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semdrift.scale import cut, scratch_path, small_side

WINDOW = 8  # a power of two, see _windows
# Share of an item's windows that a document must hold.
MIN_SHARE = 0.4
# Windows with fewer plain words than this say nothing.
MIN_PLAIN = 4
# Bounded by rows of two longs.
BROADCAST_ROWS = 500_000

# A capital with a small letter behind it, within a sentence; text in capitals has no names.
_NAME = r"(?<=[\p{Ll}\p{Nd},;:] )\p{Lu}\p{Ll}[\p{L}'’]*"
_NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
_UNIT = (
    r"§n +(?:%|°[cf]?|\p{Sc}|(?:percent|euros?|dollars?|pounds?|cents?|[kcm]?m|[km]?g|[cm]?l|km/h|mph|kwh?|mb|gb|tb|hz|"
    r"seconds?|minutes?|hours?|days?|weeks?|months?|years?|met(?:er|re)s?|kilomet(?:er|re)s?|miles?|feet|inch(?:es)?|"
    r"grams?|kilograms?|lit(?:er|re)s?|degrees?|people|times)(?!\p{L}))"
)


def _named(text: Column) -> Column:
    return F.regexp_replace(text, _NAME, "§a")


def _template(text: Column) -> Column:
    """Words of the template; §a, §n and §u stand for a name, a number and a unit."""
    numbered = F.regexp_replace(_named(F.regexp_replace(text, "§", " ")), _NUMBER, " §n ")
    united = F.regexp_replace(F.lower(numbered), _UNIT, "§n §u ")
    return F.split(F.trim(F.regexp_replace(united, r"[^\p{L}§]+", " ")), " ")


def _windows(df: DataFrame, key: str) -> DataFrame:
    """(key, at, window): hashed template windows that have enough plain words. ``df`` has key and text."""
    words = df.where("text is not null").select(key, _template(F.col("text")).alias("w")).where(F.size("w") >= WINDOW)
    step = words.select(key, F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.transform("w", lambda x: F.when(x.startswith("§"), 0).otherwise(1)).alias("p"))
    # Runs of 1, 2, 4 ... words: each pass joins a run with the one behind it.
    width = 1
    while width < WINDOW:
        rest = F.size("h") - width
        behind = lambda c, n=width, m=rest: F.slice(c, F.lit(n + 1), m)
        front = lambda c, m=rest: F.slice(c, F.lit(1), m)
        step = step.select(key, F.zip_with(front("h"), behind("h"), lambda x, y: F.xxhash64(x, y)).alias("h"), F.zip_with(front("p"), behind("p"), lambda x, y: x + y).alias("p"))
        width *= 2
    full = F.zip_with("h", "p", lambda x, y: F.when(y >= MIN_PLAIN, x))
    return step.select(key, F.posexplode(full).alias("at", "window")).where("window is not null")


def _slots(df: DataFrame, key: str) -> DataFrame:
    """(key, at, kind, value): the values that stand behind the placeholders. ``df`` has key and text."""
    plain = F.regexp_replace(F.col("text"), "§", " ")
    found = df.select(key, F.posexplode(_template(F.col("text"))).alias("at", "kind"), F.regexp_extract_all(plain, F.lit(_NAME), 0).alias("names"), F.regexp_extract_all(_named(plain), F.lit(_NUMBER), 0).alias("numbers"))
    found = found.where(F.col("kind").isin("§a", "§n"))
    nth = F.row_number().over(Window.partitionBy(key, "kind").orderBy("at")) - 1
    value = F.when(F.col("kind") == "§a", F.get("names", nth)).otherwise(F.get("numbers", nth))
    return found.select(key, "at", "kind", value.alias("value"))


def leaks(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, n_windows, n_matched, share, n_slots, consistent, contaminated) that share at
    least ``min_share`` of the item's windows at one offset; ``contaminated`` asks for consistent slots too."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    items = items.groupBy("item_id").agg(F.min("text").alias("text"))
    index = small_side(_windows(items, "item_id").withColumnRenamed("at", "item_at"), BROADCAST_ROWS)
    sizes = index.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"))
    hits = _windows(docs, "doc_id").join(index, "window").select("doc_id", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("shift"))
    lined = hits.groupBy("doc_id", "item_id", "shift").agg(F.countDistinct("item_at").alias("n_matched"))
    best = lined.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", F.negative("shift").alias("back"))).alias("b"))
    close = best.join(sizes, "item_id").select("doc_id", "item_id", "n_windows", F.col("b.n_matched").alias("n_matched"), (-F.col("b.back")).alias("shift"))
    close = cut(close.withColumn("share", F.col("n_matched") / F.col("n_windows")).where(F.col("share") >= min_share))
    with_slots = cut(_slots(items.join(close.select("item_id").distinct(), "item_id", "left_semi"), "item_id").select("item_id", F.col("at").alias("item_at"), "kind", F.col("value").alias("item_value")))
    # Only documents near an item with slots need their own values.
    needy = close.join(with_slots.select("item_id").distinct(), "item_id", "left_semi").select("doc_id").distinct()
    near = docs.join(needy, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    values = _slots(near, "doc_id")
    facing = close.select("doc_id", "item_id", "shift").join(with_slots, "item_id").withColumn("at", F.col("item_at") + F.col("shift"))
    facing = facing.join(values, ["doc_id", "at", "kind"])
    by_value = facing.groupBy("doc_id", "item_id", "kind", "item_value").agg(F.countDistinct("value").alias("n"), F.count(F.lit(1)).alias("slots"))
    slots = by_value.groupBy("doc_id", "item_id").agg(F.sum("slots").alias("n_slots"), (F.max("n") <= 1).alias("consistent"))
    out = close.join(slots, ["doc_id", "item_id"], "left")
    steady = F.coalesce("consistent", F.lit(True))
    return out.select("doc_id", "item_id", "n_windows", "n_matched", "share", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), steady.alias("consistent"), steady.alias("contaminated"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows. Each row is compared by a key of its own, whatever its id."""
    # Stored first: the keys follow the partitions, which have to be the same whenever they are read.
    path = scratch_path(docs.sparkSession, "rows")
    short = [f"c{i}" for i in range(len(docs.columns))]
    columns = [F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, short, strict=True)]
    docs.select(*columns, F.monotonically_increasing_id().alias("key")).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    found = leaks(rows, benchmark, min_share, "key", short[docs.columns.index(text)])
    gone = small_side(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct())
    return rows.join(gone, "key", "left_anti").select(*short).toDF(*docs.columns)
