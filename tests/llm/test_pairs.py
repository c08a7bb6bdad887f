"""Near duplicates, Jaccard join and repeated passages against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from semdrift.llm import embed_dedup, hashing, jaccard, spans
from semdrift.llm.components import components


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(500, 501), (7, 7)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["id"]: r["component_id"] for r in components(df).collect()}
    want = roots({x for p in links for x in p} - set(), links)
    assert got == want


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def test_shingles_match_words(monkeypatch):
    rng = random.Random(3)
    texts = ["", " \n", "one", "A b", "a B", "a b c", "x " * 50, " ".join(words_of(rng, 3000)), "é ß\tÄ ä", "Ä ä é"]
    for piece in (hashing.PIECE, 37):
        monkeypatch.setattr(hashing, "PIECE", piece)
        for t in texts:
            assert len(hashing.shingles(t, 3)) == len(shingle_set(t, 3))
    assert list(hashing.shingles("A b C d", 3)) == list(hashing.shingles("a  B\nc D", 3))
    assert list(hashing.shingles("É b c", 3)) != list(hashing.shingles("é b c", 3))
    # A long word hashes alike wherever pieces end.
    assert hashing.shingles(None, 3).size == 0


def brute_groups(docs, width, percent):
    sets = {d: shingle_set(t, width) for d, t in docs}
    links = []
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            links.append((a, b))
    return sets, roots(sets, links)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_is_exact(spark, width, percent):
    rng = random.Random(width)
    docs, at = [(0, None), (1, ""), (2, "  \n "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a a a a a a a"), (7, "a a a a a a a a")], 10
    passage = words_of(rng, 40)
    for size in (8, 20, 60, 200, 200, 200):
        base = words_of(rng, size)
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(99)}"
            if k % 4 == 3:
                copy = copy + passage
            docs.append((at, " ".join(copy) if k % 2 else " ".join(copy).upper()))
            at += 1
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = {r["doc_id"]: r for r in jaccard.jaccard_groups(df, width, percent).collect()}
    sets, want = brute_groups(docs, width, percent)
    assert {d: r["n_shingles"] for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    assert {d: r["component_id"] for d, r in got.items()} == want
    kept = {r["doc_id"] for r in jaccard.drop_jaccard_duplicates(df, width, percent).collect()}
    assert kept == {d for d in sets if want[d] == d}


def test_jaccard_join_of_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_groups(df, 3, 90).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert jaccard.jaccard_groups(df.limit(0), 3, 90).collect() == []


def test_repeated_and_null_ids_are_duplicates_too(spark):
    one, two, three = ("".join(f"{c}{k} " for k in range(30)) for c in "abc")
    rows = [(7, one), (7, one), (9, one), (None, one), (None, two), (None, two), (3, two + "x"), (5, three), (5, one), (None, three), (8, ""), (8, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in jaccard.drop_jaccard_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted([(5, one), (3, two + "x"), (5, three), (8, ""), (8, ""), (None, None)], key=repr)
    alone = [(None, one), (None, one), (None, three)]
    assert jaccard.drop_jaccard_duplicates(spark.createDataFrame(alone, "doc_id long, text string")).count() == 2


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 24))
    rows, vectors = [], []
    for i, v in enumerate(base):
        vectors.append(v)
        for spread in (0.02, 0.3, 0.45) if i % 3 == 0 else ():
            vectors.append(v + spread * rng.standard_normal(24))
    vectors += [base[0], base[0] * 2.0]
    order = rng.permutation(len(vectors))
    rows = [(int(k), [float(x) for x in vectors[j]]) for k, j in enumerate(order)]
    n = len(rows)
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24), (n + 4, [None] * 24), (n + 5, [math.inf] + [0.0] * 23), (n + 6, [1.0, 2.0]), (n + 7, [1e300, 1e300]), (n + 8, [1e-300, 1e-300])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("unit", F.lit("clash")).withColumn("label", F.lit(1))
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(df).collect()}
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    links = [(i, j) for i in range(n) for j in range(i) if cosine[i, j] >= 0.9]
    found = sum(got[i]["n_links"] for i in range(n))
    assert 0.98 * 2 * len(links) <= found <= 2 * len(links)
    want = roots(range(n), links)
    same = sum(got[i]["component_id"] == want[i] for i in range(n))
    assert same >= 0.98 * n
    for k in range(n, n + 6):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    # The same direction whatever the length, and one close to it.
    assert [got[k]["n_links"] for k in (n + 6, n + 7, n + 8)] == [2, 2, 2]
    assert got[n + 8]["component_id"] == n + 6
    assert embed_dedup.near_vectors(df.limit(0)).collect() == []


def test_collision_chance_by_simulation():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(400_000)
    y = 0.9 * x + math.sqrt(1 - 0.81) * rng.standard_normal(400_000)
    hit = ((x >= 1.5) & (y >= 1.5) & (np.abs(x - y) <= embed_dedup.WIDTH)).mean()
    assert abs(hit - embed_dedup.collision_chance(0.9, 1.5)) < 0.002


def brute_repeats(docs, min_words):
    """Sentences of every text, and those covered by spans that stood before, by text comparison."""
    seen, gone = {}, {}
    cut = {}
    for d, t in sorted((d, t) for d, t in docs if d is not None and t):
        starts = spans.sentence_starts(t)
        parts = [t[a:b] for a, b in zip(starts, [*starts[1:], len(t)])]
        cut[d] = parts
        low = [shingle_words(p) for p in parts]
        gone.setdefault(d, set())
        for i in range(len(parts)):
            run, j = [], i
            while j < len(parts) and len(run) < min_words:
                run += low[j]
                j += 1
            if len(run) < min_words:
                break
            key = tuple(run)
            if key in seen and seen[key] != (d, i):
                gone[d].update(range(i, j))
            seen.setdefault(key, (d, i))
    return {d: "".join(p for k, p in enumerate(parts) if k not in gone[d]).strip() if gone[d] else "".join(parts) for d, parts in cut.items()}


def shingle_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_repeats_against_brute_force(spark):
    rng = random.Random(9)
    sentence = lambda n: " ".join(words_of(rng, n)).capitalize() + rng.choice(".!?")
    passage = [sentence(9) for _ in range(7)]
    long_one = sentence(60)
    docs = [(0, None), (1, ""), (2, "Short one.")]
    for d in range(3, 40):
        body = [sentence(rng.randrange(1, 20)) for _ in range(12)]
        if d % 2:
            body[4:4] = passage
        if d % 5 == 0:
            body[8:8] = [long_one]
        if d % 7 == 0:
            body += passage[:3] + passage  # within one text
        docs.append((d, rng.choice([" ", "\n"]).join(body)))
    docs += [(50, docs[10][1]), (51, docs[10][1].upper().replace(" ", "  "))]
    df = spark.createDataFrame([*docs, (None, docs[10][1])], "doc_id long, text string").withColumn("at", F.lit(1)).withColumn("gone", F.lit("x"))
    rows = spans.remove_repeats(df, 25).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "at", "gone"}
    got = {r["doc_id"]: r["text"] for r in rows}
    want = brute_repeats(docs, 25)
    assert got[0] is None and got[1] == "" and got[None] == ""
    assert {d: got[d] for d in want} == want
    assert got[50] == "" and got[51] == ""
    assert spans.remove_repeats(df.limit(0)).collect() == []


def brute_closing(rows, min_words):
    """Texts without the words in repeated runs: all runs from piece to piece that the rule names, compared as words."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, gone = {}, [set() for _ in rows]
    for i in order:
        text = rows[i][1] or ""
        starts = spans.sentence_starts(text)
        parts = [shingle_words(text[a:b]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        words = [w for p in parts for w in p]
        cuts = {0, len(words)}
        at = 0
        for p in parts:
            cuts.add(at)
            if len(p) > spans.PIECE_WORDS:
                hashes = [spans.word_hashes(w)[0] for w in p]
                for k in range(len(p) - spans.PIECE_WORDS + 1):
                    window = hashes[k : k + spans.PIECE_WORDS]
                    cuts.add(at + k + window.index(min(window)))
            at += len(p)
        cuts = sorted(cuts)
        runs = {(a, next(b for b in cuts if b >= a + min_words)) for a in cuts if a + min_words <= len(words)}
        runs |= {(max(a for a in cuts if a <= b - min_words), b) for b in cuts if b >= min_words}
        for a, b in sorted(runs):
            if seen.setdefault(tuple(words[a:b]), (i, a)) != (i, a):
                gone[i].update(range(a, b))
    return [None if t is None else [w for k, w in enumerate(shingle_words(t)) if k not in g] for (_, t), g in zip(rows, gone, strict=True)]


def test_registered_repeats_against_brute_force(spark):
    rng = random.Random(21)
    sentence = lambda n: " ".join(words_of(rng, n, 10**9)).capitalize() + rng.choice(".!?")
    passages = [" ".join(sentence(rng.randrange(3, 45)) for _ in range(6)).split() for _ in range(4)]
    rows = []
    for d in range(60):
        body = " ".join(sentence(rng.randrange(2, 40)) for _ in range(rng.randrange(1, 9))).split()
        for _ in range(rng.randrange(3)):
            p, at = rng.choice(passages), rng.randrange(len(body))
            a = rng.randrange(10)
            body[at:at] = p[a : a + rng.randrange(26, 70)]
        rows.append((rng.choice([None, d // 3, d // 3, 7]), rng.choice([" ", "\n"]).join(body)))
    unrelated = " ".join(sentence(20) for _ in range(5))
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, unrelated), (7, unrelated[::-1]), (1, None), (None, ""), (4, " ".join(words_of(rng, 30_000, 10**9)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("c0", F.lit(2)).withColumn("gone", F.lit(3)).coalesce(1)
    with_place = df.withColumn("place", F.monotonically_increasing_id())
    for parts in (1, 4):
        got = spans.remove_repeats(with_place.repartitionByRange(parts, "place").sortWithinPartitions("place"), closing=True)
        assert got.columns == with_place.columns
        found = {r["place"]: r for r in got.collect()}
        assert [(found[i]["doc_id"], found[i]["key"], found[i]["c0"]) for i in range(len(rows))] == [(d, "clash", 2) for d, _ in rows]
        texts = [found[i]["text"] for i in range(len(rows))]
        assert [None if t is None else shingle_words(t) for t in texts] == brute_closing(rows, spans.MIN_WORDS)


def test_repeats_count_sentences(spark):
    text = "One two three. Four five six. Seven."
    df = spark.createDataFrame([Row(doc_id=1, text=text), Row(doc_id=2, text=text)])
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"]) for r in spans.remove_repeats(df, 5, counts=True).collect()}
    assert got[1] == (3, 0, text)
    assert got[2] == (3, 2, "Seven.")


def test_repeats_reach_the_ends_of_passages(spark):
    rng = random.Random(4)
    sentence = lambda n: " ".join(words_of(rng, n, 10**9)).capitalize() + "."
    closing = sentence(40) + " " + sentence(12)
    got = {r["doc_id"]: r for r in spans.remove_repeats(spark.createDataFrame([(d, f"{sentence(9)} {closing} {sentence(9)}") for d in range(3)], "doc_id long, text string"), counts=True, closing=True).collect()}
    assert all(w not in got[d]["text"].split() for d in (1, 2) for w in closing.split())
    assert [(got[d]["n_sentences"], got[d]["n_removed"], len(got[d]["text"].split())) for d in range(3)] == [(4, 0, 70), (4, 2, 18), (4, 2, 18)]
    # Passages of 61 words cut out of running text, put into other texts at any word, sentence ends of other scripts.
    for stop in (".", ".”", " ۔", "…", " ।"):
        long_text = " ".join(sentence(rng.randrange(5, 60))[:-1] + stop for _ in range(6)).split()
        passage = long_text[7:68]
        docs = []
        for d in range(8):
            body = " ".join(sentence(rng.randrange(5, 30)) for _ in range(8)).split()
            at = rng.randrange(len(body))
            docs.append((d, " ".join(body[:at] + passage + body[at:]), body))
        for r in spans.remove_repeats(spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string"), closing=True).collect():
            left = r["text"].split()
            own = docs[r["doc_id"]][2]
            assert set(own) <= set(left)
            tail = len(left) - len(own)
            assert tail == 61 if r["doc_id"] == 0 else tail <= 2 * spans.PIECE_WORDS


def test_sentences_of_scripts_without_spaces():
    assert spans.sentence_starts("你好。再见！」走\x85x.  Y") == [0, 3, 7, 9, 13]
    h, at, n = spans.spans("你好。再见！ 走.  Y z", 3, True)
    assert at.max() + n.max() <= 6 and len(h)


def test_a_pair_that_shares_many_lists_is_made_about_once(spark):
    """Every pair that the lists hold is made, however their members overlap, and the count of shared lists is exact."""
    draw = random.Random(5)
    lists = {i: sorted(draw.sample(range(300), 60 if i < 12 else 250)) for i in range(20)}
    rows = [(tok, i, i % 4, 500, *[0] * 8) for i, toks in lists.items() for tok in toks]
    open_ = spark.createDataFrame(rows, f"tok long, id long, c long, n long, {', '.join(c + ' long' for c in jaccard.SKETCHES)}")
    made = [tuple(r) for r in jaccard._open_pairs(open_, 80).collect()]
    met = {(b, a): len(set(lists[a]) & set(lists[b])) for a, b in itertools.combinations(lists, 2) if a % 4 != b % 4}
    assert set(made) == {p for p, n in met.items() if n}
    assert len(made) < sum(met.values()) / 8
    pairs = spark.createDataFrame(sorted(set(made)), "a long, b long")
    kept = {tuple(r) for r in jaccard._often_met(pairs, open_, 80).collect()}
    assert kept == {p for p, n in met.items() if n >= 1 + jaccard.SLACK} and kept < set(made)
