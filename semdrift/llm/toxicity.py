"""Toxicity of whole texts: Levenshtein automata intersected with a lexicon trie.

The lexicon is learned: prefixes and words that labelled toxic texts hold far more often than clean ones form a
trie. Its product with the automata of edit distance one is made deterministic and run over all words of a batch
at once, so that misspelled terms are found as well. Hits are weighed by their context window: whether they
stand in quotation, and how close together they are. A logistic function of these figures is the score.

Null and empty texts get the score of a text without hits. Every row is scored, repeated ids included. Without
labels of both kinds no term is known and every text scores the toxic share of the labels, or 0.0 without any.
Extra columns are ignored. Texts are processed whole, in pieces cut between words.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.llm.frames import marked_sample

# The classifier is fitted on about this many distinct labelled texts of each kind.
SAMPLE_PER_LABEL = 2500
MIN_TEXTS = 5
MIN_ODDS = 20.0
# Terms are prefixes of these lengths, or shorter whole words that end in END.
PREFIX = range(4, 9)
END = "$"
# Shorter terms are matched exactly only: their neighbours are ordinary words.
MIN_FUZZY = 5
NEAR_WORDS = 20
_WORD = re.compile(r"[^\W_]+")
_PIECE = 1 << 18
_OPEN, _CLOSE, _FLAT = "“«„‹", "”»›", '"'

DEAD, START = 0, 1


@dataclass
class Automaton:
    """Deterministic table over character classes. Class 0 ends a word, 1 is any character no term holds."""

    classes: np.ndarray
    table: np.ndarray
    odds: np.ndarray  # log-odds of each term
    exact: np.ndarray  # by state: 1 + term, or 0
    fuzzy: np.ndarray  # by state: whether a term is within one edit
    depth: int

    def run(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start offsets of all words, and of each word 1 + term or 0, and whether it is a fuzzy hit."""
        kind = self.classes[np.minimum(text, len(self.classes) - 1)]
        padded = np.concatenate((kind, np.zeros(1, kind.dtype)))
        inside = padded > 0
        starts = np.flatnonzero(inside[:-1] & ~np.concatenate(([False], inside[:-2])))
        last = np.full(len(starts), START, np.int32)
        live = np.arange(len(starts))
        state = last.copy()
        for k in range(self.depth):
            state = self.table[state, padded[np.minimum(starts[live] + k, len(padded) - 1)]]
            last[live] = state
            going = (state != DEAD) & (self.exact[state] == 0)
            live, state = live[going], state[going]
            if not len(live):
                break
        # A word that is over has met an end class, which leaves no live state behind.
        return starts, self.exact[last], self.fuzzy[last]


@cache
def _plain_classes() -> np.ndarray:
    """1 for every code point that may be in a word, else 0; classes of terms' characters take the numbers from 2 on."""
    return np.array([chr(c).isalnum() for c in range(sys.maxunicode + 1)], np.uint32)


def build(terms: list[str], fuzzy: set[str], odds: list[float] | None = None) -> Automaton:
    """Product of the trie of ``terms`` with automata that allow one edit of those in ``fuzzy``. ``odds`` weighs terms."""
    alphabet = sorted(set("".join(terms)) - {END})
    classes = _plain_classes().copy()
    code = {c: i + 2 for i, c in enumerate(alphabet)}
    for c, i in code.items():
        classes[ord(c)] = i
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    soft: set[int] = set()
    soft_ends: set[int] = set()
    for t, term in enumerate(terms):
        at, path = 0, [0]
        for c in term:
            at = children[at].setdefault(0 if c == END else code[c], len(children))
            if at == len(children):
                children.append({})
            path.append(at)
        ends[at] = t
        if term in fuzzy:
            soft.update(path)
            soft_ends.add(at)
    hit = -1  # stands for "a term within one edit was seen"

    def closure(items: set[tuple[int, int]]) -> frozenset | int:
        todo, seen = list(items), set()
        while todo:
            node, edits = todo.pop()
            if (node, edits) in seen:
                continue
            if node in ends and edits == 0:
                return ends[node]
            if edits and node in soft_ends:
                seen.add((hit, 1))
            seen.add((node, edits))
            if edits == 0 and node in soft:
                todo += [(n, 1) for k, n in children[node].items() if n in soft and k]
        if (hit, 1) in seen:
            seen = {(n, e) for n, e in seen if e == 0 or n == hit}
        return frozenset(seen)

    def step(state: frozenset, kind: int) -> frozenset | int:
        out: set[tuple[int, int]] = set()
        for node, edits in state:
            if node == hit:
                out.add((hit, 1))
                continue
            nxt = children[node].get(kind)
            if nxt is not None and (edits == 0 or nxt in soft):
                out.add((nxt, edits))
            if edits == 0 and node in soft and kind:
                out.add((node, 1))
                out.update((n, 1) for k, n in children[node].items() if n in soft and k)
        return closure(out)

    kinds = len(alphabet) + 2
    start = closure({(0, 0)})
    names: dict = {frozenset(): DEAD, start: START}
    order: list = [frozenset(), start]
    rows: list[list[int]] = []
    at = 0
    while at < len(order):
        state = order[at]
        row = [DEAD] * kinds
        if isinstance(state, frozenset):
            for kind in range(kinds):
                nxt = step(state, kind)
                if kind == 0 and isinstance(nxt, frozenset):
                    nxt = nxt & {(hit, 1)}
                if nxt not in names:
                    names[nxt] = len(order)
                    order.append(nxt)
                row[kind] = names[nxt]
            if state == frozenset({(hit, 1)}):
                row[0] = names[state]
        rows.append(row)
        at += 1
    exact = np.array([0 if isinstance(s, frozenset) else s + 1 for s in order], np.int32)
    near = np.array([isinstance(s, frozenset) and (hit, 1) in s for s in order], bool)
    weight = np.array([1.0] * len(terms) if odds is None else odds)
    return Automaton(classes, np.array(rows, np.int32), weight, exact, near, max((len(t) for t in terms), default=0) + 2)


FEATURES = 9


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    automaton: Automaton | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = hit_features(self.automaton, texts)
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        stop = min(len(text), at + _PIECE)
        if stop < len(text):
            gap = max(text.rfind(" ", at, stop), text.rfind("\n", at, stop))
            stop = gap + 1 if gap > at else stop
        yield text[at:stop]
        at = stop


def hit_features(automaton: Automaton | None, texts: list[str | None]) -> np.ndarray:
    """Figures of each text: exact and fuzzy hits, in and out of quotation, how many of them lie close together,
    and the log-odds of the terms."""
    out = np.zeros((len(texts), FEATURES))
    if automaton is None:
        return out
    for i, text in enumerate(texts):
        counts, most, evidence = np.zeros(4), 0, {}
        for piece in _pieces(text.lower() if text else ""):
            chars = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
            starts, exact, fuzzy = automaton.run(chars)
            found = np.flatnonzero((exact > 0) | fuzzy)
            quoted = np.zeros(len(found), bool)
            if len(found):
                if any(c in piece for c in _OPEN + _CLOSE + _FLAT):
                    quoted = _quoted(chars, starts[found])
                sure = exact[found] > 0
                for k, mask in enumerate((sure & ~quoted, sure & quoted, ~sure & ~quoted, ~sure & quoted)):
                    counts[k] += mask.sum()
                for t in exact[found[sure & ~quoted]]:
                    evidence[t] = automaton.odds[t - 1]
                open_ = found[~quoted]
                if len(open_):
                    most = max(most, int((np.searchsorted(open_, open_ + NEAR_WORDS) - np.arange(len(open_))).max()))
        out[i] = [*np.log1p(counts), counts[0] > 0, counts[2] > 0, np.log1p(max(most - 1, 0)), min(sum(evidence.values()), 20.0) / 5, counts[0] + counts[2] == 0 and counts[1] + counts[3] > 0]
    return out


def _quoted(chars: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each offset lies within quotation marks; a mark without a partner in the piece opens nothing."""
    flat = np.flatnonzero(chars == ord(_FLAT))
    flat = flat[: len(flat) // 2 * 2]
    inside = np.searchsorted(flat, at) % 2 == 1
    opens = np.isin(chars, [ord(c) for c in _OPEN])
    closes = np.isin(chars, [ord(c) for c in _CLOSE])
    if opens.any() and closes.any():
        level = np.cumsum(opens.astype(int) - closes)
        inside |= level[at] > 0
    return inside


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the bias is last and not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(len(beta), ridge * w.sum() / 10)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + penalty * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        move = np.linalg.solve(hess, grad)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return beta


def _term_counts(sample: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch["txt"].to_pylist(), batch["lab"].to_pylist(), strict=True):
                terms: set[str] = set()
                for word in set(_WORD.findall(text.lower())):
                    terms.update(word[:k] for k in PREFIX if k <= len(word))
                    if 3 <= len(word) < PREFIX[0]:
                        terms.add(word + END)
                seen[int(label)].update(terms)
        names = [t for t in seen[1] | seen[0]]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][t] for t in names], pa.int64()) for k in (1, 0))], names=["term", "toxic", "clean"])

    return sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Learn lexicon and weights from the documents that ``labels`` (id, label) marks 0 or 1."""
    sample, total = marked_sample(docs, labels, id_col, text, label, per_label)
    model = ToxicityModel()
    prior = total.get(1, 0) / max(sum(total.values()), 1)
    if not (total.get(0) and total.get(1)):
        model.weights[-1] = np.log(max(prior, 1e-15) / max(1 - prior, 1e-15))
        return model
    sample = sample.select(F.coalesce("txt", F.lit("")).alias("txt"), "lab").distinct().persist()
    n = {r["lab"]: r["count"] for r in sample.groupBy("lab").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    counted = _term_counts(sample).where((F.col("toxic") >= MIN_TEXTS) & (odds >= MIN_ODDS))
    counted = counted.withColumn("odds", F.log(odds))
    # As many terms as the bounded sample holds.
    rows = counted.orderBy(F.desc("toxic"), "term").collect()
    chosen: dict[str, int] = {}
    strength = {r["term"]: r["odds"] for r in rows}
    for r in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):
        t = r["term"]
        if not any(t[:k] in chosen for k in range(1, len(t))):
            chosen[t] = r["toxic"]
    model.terms = sorted(chosen, key=lambda t: (-chosen[t], t))
    # One edit is allowed in terms that are common enough not to be chance: rare ones may be words of one copied text,
    # and what is near those is found in clean texts too.
    frequent = {t for t in model.terms if chosen[t] >= max(MIN_TEXTS, n_toxic // 50)}
    # A short prefix that always goes on the same way is lengthened as far as it does.
    full = {t: t for t in frequent}
    for r in rows:
        for t in (r["term"][:k] for k in range(1, len(r["term"]))):
            if t in full and r["toxic"] >= 0.9 * chosen[t] and len(r["term"]) > len(full[t]):
                full[t] = r["term"]
    model.terms = [full.get(t, t) for t in model.terms]
    soft = {full[t] for t in frequent if len(full[t]) >= MIN_FUZZY and END not in full[t]}
    model.automaton = build(model.terms, soft, [strength[t] for t in model.terms])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = hit_features(model.automaton, batch["txt"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["lab"], pa.array(list(x), pa.list_(pa.float64()))], names=["lab", "x"])

    fitted = sample.select("lab", "txt").mapInArrow(encode, "lab int, x array<double>").groupBy("lab", "x").count().collect()
    sample.unpersist()
    fitted.sort(key=lambda r: (r["lab"], r["x"]))
    y = np.array([r["lab"] for r in fitted], float)
    size = np.array([r["count"] for r in fitted], float)
    # The sample is balanced; the weights bring back the share of each kind.
    size *= np.where(y == 1, prior / max(n_toxic, 1), (1 - prior) / max(n_clean, 1)) * (n_toxic + n_clean)
    model.weights = _logistic(np.array([r["x"] for r in fitted], float), y, size)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(batch["text"].to_pylist()))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    scored = rows.mapInArrow(score, rows.select("doc_id", F.lit(0.0).alias("score")).schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
