"""Substring deduplication by sliding sentence spans.

A text is cut into sentences. At each sentence starts one span: the fewest consecutive sentences, usually
several, that hold at least ``min_words`` words. Spans are hashed and joined over all documents; every
occurrence but the first (smallest id, then position) is repeated, and the sentences it covers are removed.
Spans ignore letter case and the kind of white space.

With ``closing``, as in the query and the pipeline, two things are added. Sentences of more than ``PIECE_WORDS``
words are cut into pieces of at most so many, at words chosen by their hashes, so copies are cut alike wherever
they stand. And at each piece also ends one span, the shortest with ``min_words`` words, so the end of a passage
is covered as its start is. A passage that starts or ends inside a sentence then loses all but up to
``PIECE_WORDS`` words at either side, and is found for certain from ``min_words`` + 3 * ``PIECE_WORDS`` words on.
Without ``closing`` it loses only its whole sentences.

Rows are compared by a key of their own, so rows that share an id, repeat each other or have a null id are like any
others; the first occurrence is that of the smallest id (null ids last), of equal ids in the row that was read
first. Null texts stay null, empty ones empty; a text that is wholly repeated becomes empty, its row stays. Extra
columns are kept, but for ``n_sentences`` and ``n_removed`` where these are asked for.

The spans are computed once and shuffled once. Within an Arrow batch only the first occurrence of a span goes on as
such, the others are merged to ranges there, so a span that a third of all texts hold is one row per batch. Only
texts with something to remove are shuffled; a bit table of their keys, of bounded size, tells them apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semdrift.llm.hashing import mix, word_hashes
from semdrift.scale import cut, scratch_path

MIN_WORDS = 25
PIECE_WORDS = 12
# Bits, as a power of two, of the largest table of keys that is broadcast: 128 MB.
TABLE_BITS = 30
# White space behind a full stop and the quotes or brackets that follow it, full-width stops, line breaks.
_BREAK = re.compile(r"[.!?…‽؟۔։।॥။።][\"'”’»)\]]*\s+|[。！？｡．][”’」』）]*\s*(?![。！？｡．])|[\n\r\v\f\x85\u2028\u2029]+")
# White space that str.split knows and ``word_hashes`` does not.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(r"[^ \t-\r]+")
_MULT = 0xD6E8FEB86659FD93
_TABLES: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse."""
    if len(_TABLES[0]) < n:
        for k, base in enumerate((_MULT, pow(_MULT, -1, 2**64))):
            row = np.full(2 * n, base, np.uint64)
            row[0] = 1
            _TABLES[k] = np.multiply.accumulate(row)
    return _TABLES


def sentence_starts(text: str) -> list[int]:
    """Offsets at which sentences begin: after line breaks, and after white space that follows the end of one."""
    last = len(text)
    return [0, *(end for m in _BREAK.finditer(text) if (end := m.end()) < last)]


def _piece_starts(words: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Word numbers at which the pieces of sentences of more than ``PIECE_WORDS`` words begin, the first ones left out.

    Of every ``PIECE_WORDS`` consecutive words of such a sentence the one with the smallest hash begins a piece.
    """
    if len(words) <= PIECE_WORDS:
        return np.empty(0, np.int64)
    sentence = np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    within = sentence[: 1 - PIECE_WORDS] == sentence[PIECE_WORDS - 1 :]
    begin = np.flatnonzero(within & (np.diff(upto) > PIECE_WORDS)[sentence[: 1 - PIECE_WORDS]])
    least = np.full(len(begin), np.iinfo(np.uint64).max)
    at = begin.copy()
    for k in range(PIECE_WORDS):
        h = words[begin + k]
        at = np.where(h < least, begin + k, at)
        least = np.minimum(h, least)
    return np.unique(at)


def spans(text: str, min_words: int, closing: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and sentence count of each span; with ``closing`` first word and word count."""
    starts = sentence_starts(text)
    ends = [*starts[1:], len(text)]
    words = word_hashes(text)
    odd = _ODD_SPACE.search(text)
    if len(starts) == 1:
        count = np.array([len(words)])
    elif not odd:
        count = np.array([len(text[a:b].split()) for a, b in zip(starts, ends, strict=True)])
    if len(starts) > 1 and (odd or count.sum() != len(words)):  # a word may go on behind the end of a sentence
        parts = [word_hashes(text[a:b]) for a, b in zip(starts, ends, strict=True)]
        count, words = np.array([len(p) for p in parts]), np.concatenate(parts)
    upto = np.concatenate(([0], np.cumsum(count)))
    if closing:
        upto = np.union1d(upto, _piece_starts(words, upto))
    first = np.flatnonzero(upto[:-1] + min_words <= upto[-1])
    last = np.searchsorted(upto, upto[first] + min_words)
    if closing:
        stop = np.flatnonzero(upto >= min_words)
        begin = np.searchsorted(upto, upto[stop] - min_words, side="right") - 1
        both = np.unique(np.concatenate((first * len(upto) + last, begin * len(upto) + stop)))
        first, last = np.divmod(both, len(upto))
    up, down = _powers(len(words) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])))
    # Shifted to power zero, equal runs are equal wherever they stand.
    same = (total[upto[last]] - total[upto[first]]) * down[upto[first]]
    h = mix(same ^ (upto[last] - upto[first]).astype(np.uint64))
    return (h, upto[first], upto[last] - upto[first]) if closing else (h, first, last - first)


def _first_and_later(h: np.ndarray, order: np.ndarray, row: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the spans of a batch the places of the first occurrences, and rows (row, start, stop) of what the others cover.

    ``order`` says which rows come first.
    """
    by = np.lexsort((at, order, h))
    first = np.ones(len(by), bool)
    first[1:] = h[by[1:]] != h[by[:-1]]
    later = by[~first]
    later = later[np.lexsort((at[later], row[later]))]
    # Ranges of a row are joined where they touch: laid end to end, rows apart, one running maximum finds the gaps.
    if not len(later):
        return by[first], np.empty((0, 3), np.int64)
    wide = int((at[later] + n[later]).max()) + 2
    start, stop = row[later] * wide + at[later], row[later] * wide + at[later] + n[later]
    reach = np.maximum.accumulate(stop)
    opens = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    closes = np.append(opens[1:], len(later)) - 1
    return by[first], np.column_stack((row[later][opens], start[opens] % wide, reach[closes] % wide))


def span_table(keyed: DataFrame, min_words: int = MIN_WORDS, closing: bool = False) -> DataFrame:
    """(span, later, none, id, key, at, n) for documents (key, id, text).

    One row for each span of a batch at its first place there; with ``later`` also one for each range of the batch
    that is repeated for certain. ``none`` marks null ids.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for i, value in enumerate(batch["text"]):
                h, at, n = spans(value.as_py(), min_words, closing)
                if len(h):
                    parts.append((h, np.full(len(h), i), at, n))
            if not parts:
                continue
            h, row, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, ids = batch["key"].to_numpy(), batch["id"]
            none = np.asarray(ids.is_null())
            known = ids.fill_null(0).to_numpy()
            order = np.empty(len(keys), np.int64)
            order[np.lexsort((keys, known, none))] = np.arange(len(keys))
            first, more = _first_and_later(h, order[row], row, at, n)
            at = np.concatenate((at[first], more[:, 1]))
            n = np.concatenate((n[first], more[:, 2] - more[:, 1]))
            row = np.concatenate((row[first], more[:, 0]))
            span = np.concatenate((h[first], mix(keys[more[:, 0]].astype(np.uint64)))).view(np.int64)
            later = np.arange(len(at)) >= len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(span), pa.array(later), pa.array(none[row]), pa.array(known[row]), pa.array(keys[row]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                names=["span", "later", "none", "id", "key", "at", "n"],
            )

    known = keyed.select("key", "id", "text").where("text <> ''")
    return known.mapInArrow(cut_up, "span long, later boolean, none boolean, id long, key long, at int, n int")


def repeated_ranges(keyed: DataFrame, min_words: int = MIN_WORDS, closing: bool = False) -> DataFrame:
    """(key, gone): ranges [at, at + n) of sentences, with ``closing`` of words, in repeated spans that are not the first."""
    place = Window.partitionBy("span").orderBy("later", "none", "id", "key", "at")
    table = span_table(keyed, min_words, closing).withColumn("rank", F.row_number().over(place))
    return table.where("later or rank > 1").groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("gone"))


def _likely(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key may be among ``keys``, and those whose key is not, by a broadcast bit table.

    The table has some 16 bits per key, but at most 2 ** ``TABLE_BITS``; beyond that more rows pass for likely.
    """
    bits = min(TABLE_BITS, max(16, (16 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    marked = rows.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(words), "word", "left")
    hit = F.coalesce(F.getbit("bits", (place % 64).cast("int")) == 1, F.lit(False))
    return marked.where(hit).drop("word", "bits"), marked.where(~hit).drop("word", "bits")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text", counts: bool = False, closing: bool = False) -> DataFrame:
    """``docs`` with the repeated sentences cut out of ``text``; with ``counts`` also n_sentences and n_removed, the
    sentences that lost words."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if not (counts and c in ("n_sentences", "n_removed"))]
    # Stored first: the keys follow the partitions, which have to be the same whenever they are read.
    path = scratch_path(spark, "rows")
    short = [f"c{i}" for i in range(len(names))]
    columns = [F.col(f"`{c}`").alias(k) for c, k in zip(names, short, strict=True)]
    docs.select(*columns, F.monotonically_increasing_id().alias("key")).write.parquet(path)
    rows = spark.read.parquet(path)
    where = names.index(text)
    keyed = rows.select("key", F.col(short[names.index(id_col)]).cast("long").alias("id"), F.col(short[where]).alias("text"))
    gone = cut(repeated_ranges(keyed, min_words, closing))
    some, others = _likely(rows, gone.select("key"))
    some = some.join(gone, "key", "left").select(*short, "gone")
    extra = [F.lit(0).alias("n_sentences"), F.lit(0).alias("n_removed")] if counts else []
    schema = docs.select(*[F.col(f"`{c}`") for c in names], *extra).schema

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            ranges_of = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else [None] * len(batch)
            for value, ranges in zip(batch.column(where), ranges_of, strict=True):
                t, n, r = _without(value.as_py(), ranges, counts, closing)
                texts.append(t)
                total.append(n)
                removed.append(r)
            out = [batch.column(i) for i in range(len(names))]
            out[where] = pa.array(texts, out[where].type)
            if counts:
                out += [pa.array(total, pa.int32()), pa.array(removed, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    whole = others.select(*short)
    whole = whole.mapInArrow(strip, schema) if counts else whole.toDF(*names)
    return some.mapInArrow(strip, schema).union(whole)


def _without(text: str | None, ranges: list[dict] | None, counts: bool, closing: bool = False) -> tuple[str | None, int, int]:
    if not text or not (ranges or counts):
        return text, 0, 0
    sentences = starts = sentence_starts(text)
    if not ranges:
        return text, len(starts), 0
    if closing:
        starts = [m.start() + a for a, b in zip(starts, [*starts[1:], len(text)], strict=True) for m in _WORD.finditer(text[a:b])]
    gone = np.zeros(len(starts), bool)
    for r in ranges:
        gone[r["at"] : r["at"] + r["n"]] = True
    ends = [*starts[1:], len(text)]
    kept = text[: starts[0]] + "".join(text[a:b] for a, b, g in zip(starts, ends, gone, strict=True) if not g)
    changed = np.unique(np.searchsorted(sentences, np.array(starts)[gone], side="right"))
    return kept.strip() if gone.any() else text, len(sentences), len(changed)
