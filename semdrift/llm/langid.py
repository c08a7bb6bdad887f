"""Hierarchical language identification: family first, then one-versus-one linear SVMs within the family.

Empty tables give empty results. A null text, or one without a letter (Unicode categories L), is
``und`` with score 1.0. Rows with
equal ids are each predicted. Extra columns are kept by ``filter_language`` and ignored by ``predict_language``.
Without any usable training row every text is ``und`` with score 0.0. Whole texts are used, however long;
ties between languages go to the first in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.llm.frames import bounded_sample

DIM = 1 << 13
# The classifier is fitted on about this many texts of each language, chosen by the hash of their ids.
SAMPLE_PER_LANG = 400
MAX_LANGS = 200
UND = "und"
_PIECE = 1 << 20
# Control characters, digits and ASCII signs all read as one space.
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def features(text: str) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed runs of 3 and 4 lower-case bytes."""
    raw = _CLASS[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    counts = np.zeros(DIM, np.int64)
    for at in range(0, max(1, len(raw) - 2), _PIECE):
        b = raw[at : at + _PIECE + 3]
        keep = (b[:-1] != 32) | (b[1:] != 32)
        b = b[np.flatnonzero(np.concatenate(([True], keep)))]
        if len(b) < 4:
            continue
        three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
        four = three[:-1] | b[3:] << np.uint32(24)
        for grams in (three, four):
            counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(19), minlength=DIM)
    out = np.sqrt(counts.astype(np.float32))
    return out / max(float(np.linalg.norm(out)), 1e-9)


@dataclass
class LanguageModel:
    """Families of languages, and weights of the machines: rows of ``weights`` with a bias at the end."""

    families: list[list[str]]
    family_weights: np.ndarray  # one row per pair of families
    pair_weights: list[np.ndarray]  # per family, one row per pair of its languages

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score in 0..1 of each feature row."""
        family, sure = _vote(x, self.family_weights, len(self.families))
        lang = np.empty(len(x), object)
        for k, names in enumerate(self.families):
            mine = np.flatnonzero(family == k)
            if len(mine):
                pick, inner = _vote(x[mine], self.pair_weights[k], len(names))
                lang[mine] = np.array(names, object)[pick]
                sure[mine] *= inner
        return lang, sure


def _vote(x: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner of all pairwise machines, and the mean probability of its duels."""
    if n == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    margin = x @ weights[:, :-1].T.astype(np.float32) + weights[:, -1].astype(np.float32)
    won = 1.0 / (1.0 + np.exp(-4.0 * margin.astype(np.float64)))
    total = np.zeros((len(x), n))
    for at, (i, j) in enumerate((i, j) for i in range(n) for j in range(i + 1, n)):
        total[:, i] += won[:, at]
        total[:, j] += 1.0 - won[:, at]
    best = total.argmax(axis=1)
    return best, total[np.arange(len(x)), best] / (n - 1)


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, reg: float = 1e-4) -> np.ndarray:
    """Linear machine by dual coordinate descent on the squared hinge loss; y is +1 / -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    diag = 1.0 / (2.0 * (1.0 / (reg * len(x))))
    norms = (x * x).sum(axis=1) + diag
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    order = np.random.default_rng(5)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            grad = y[i] * (w @ x[i]) - 1.0 + diag * alpha[i]
            new = max(alpha[i] - grad / norms[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _pairs(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    rows = []
    for i in range(n):
        for j in range(i + 1, n):
            mine = (y == i) | (y == j)
            rows.append(_svm(x[mine], np.where(y[mine] == i, 1.0, -1.0)))
    return np.array(rows).reshape(-1, x.shape[1] + 1)


def _families(centres: np.ndarray, names: list[str]) -> list[list[str]]:
    """About sqrt(n) groups of languages, by average-link merging of their mean profiles."""
    groups = [[i] for i in range(len(names))]
    like = centres @ centres.T
    while len(groups) > max(1, round(len(names) ** 0.5)):
        score, a, b = max((like[np.ix_(g, h)].mean(), -i, -j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        groups[-a] += groups.pop(-b)
    return sorted(sorted(names[i] for i in g) for g in groups)


def fit_language(docs: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", per_lang: int = SAMPLE_PER_LANG) -> LanguageModel | None:
    """Fit on a bounded sample of the labelled ``docs`` (``per_lang`` texts of each of ``MAX_LANGS`` languages)."""
    known = docs.select(F.col(id_col).alias("id"), F.col(label).alias("lab"), F.col(text).alias("txt")).where(F.col("lab").isNotNull() & F.col("txt").rlike(r"\p{L}"))
    sample, labels = bounded_sample(known, "lab", "id", per_lang, MAX_LANGS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch["txt"].to_pylist()]
            packed = [np.flatnonzero(r).astype(np.uint16).tobytes() + r[r > 0].astype(np.float16).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch["id"].cast(pa.string()), batch["lab"].cast(pa.string()), pa.array(packed, pa.binary())], names=["id", "lab", "x"])

    rows = sample.mapInArrow(encode, "id string, lab string, x binary").collect() if labels else []
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lab"], r["id"] or "", bytes(r["x"])))
    x = np.zeros((len(rows), DIM), np.float32)
    for i, r in enumerate(rows):
        n = len(r["x"]) // 4
        x[i, np.frombuffer(r["x"][: 2 * n], np.uint16)] = np.frombuffer(r["x"][2 * n :], np.float16)
    names = sorted({r["lab"] for r in rows})
    y = np.array([names.index(r["lab"]) for r in rows])
    centres = np.array([x[y == i].mean(axis=0) for i in range(len(names))])
    families = _families(centres / np.linalg.norm(centres, axis=1, keepdims=True), names)
    group = np.array([next(k for k, f in enumerate(families) if n in f) for n in names])[y]
    inner = []
    for k, f in enumerate(families):
        mine = group == k
        inner.append(_pairs(x[mine], np.array([f.index(names[i]) for i in y[mine]]), len(f)))
    return LanguageModel(families, _pairs(x, group, len(families)), inner)


def predict_language(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns with lang_pred and score; by default all columns but those two names are kept."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")] if keep is None else keep
    source = docs.select(*kept, F.col(text).alias("__text"))
    schema = source.select(*[c for c in source.columns if c != "__text"], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch["__text"].to_pylist()
                lang, score = np.full(len(texts), UND, object), np.ones(len(texts))
                lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                if model is None:
                    score[lettered] = 0.0
                elif lettered:
                    lang[lettered], score[lettered] = model.predict(np.array([features(texts[i]) for i in lettered]))
                columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return source.mapInArrow(predict, schema)


def filter_language(docs: DataFrame, model: LanguageModel | None, languages: list[str] | None = None, min_score: float = 0.5, text: str = "text") -> DataFrame:
    """Documents in one of ``languages`` (default: any learned one) with at least ``min_score``; ``und`` goes.

    A score is the product of two duels, each won with one half at least, so no learned language scores less than 0.25
    and a threshold up to that lets everything pass. The default leaves out texts whose family and language together
    are less likely right than wrong.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    judged = docs.select(F.struct(*columns).alias("row"), F.col(text).alias("t"))
    judged = predict_language(judged, model, "t", [F.col("row")])
    fine = (F.col("lang_pred") != UND) & (F.col("score") >= min_score)
    if languages is not None:
        fine &= F.col("lang_pred").isin(languages)
    return judged.where(fine).select("row.*")
