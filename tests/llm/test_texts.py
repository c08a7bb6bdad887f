"""Language, tokens, toxicity, quality, pages, mixing and decontamination on small fixtures."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from semdrift.llm import decontam, html_extract, langid, mixing, quality, tokens, toxicity

STEMS = {
    "en": ["thing", "and", "wher", "ation", "ould", "ight"],
    "de": ["ung", "keit", "sch", "lich", "über", "heit"],
    "fr": ["eau", "eux", "tion", "què", "ille", "ment"],
    "es": ["ción", "mente", "ado", "ñar", "uez", "llo"],
}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


# ---- language ----------------------------------------------------------------


def test_language_families_and_held_out_accuracy(spark):
    rng = random.Random(1)
    docs = [(i, invented(rng, lang, 60), lang, "x") for i, lang in enumerate(rng.choices(list(STEMS), k=160))]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score string")
    model = langid.fit_language(df.where("doc_id % 2 = 0"))
    assert sorted(n for f in model.families for n in f) == sorted(STEMS)
    assert len(model.families) == 2
    rows = langid.predict_language(df.where("doc_id % 2 = 1").select("doc_id", "text", "lang"), model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    # Whole texts: what stands behind a long foreign part decides.
    mixed = [(1, invented(rng, "de", 20) + " " + invented(rng, "en", 40_000)), (2, None), (3, ""), (4, "½ ² ① 12 %&"), (5, invented(rng, "es", 300)), (5, invented(rng, "es", 300))]
    got = langid.predict_language(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "es"), (5, "es")]
    assert [r["score"] for r in got[1:4]] == [1.0, 1.0, 1.0]
    kept = langid.filter_language(df, model, ["de", "en"])
    assert kept.columns == df.columns
    assert {r["lang"] for r in kept.collect()} == {"de", "en"}


def test_language_without_examples(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert langid.fit_language(df) is None
    got = langid.predict_language(df, None).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0), ("und", 1.0)]
    assert langid.filter_language(df, None).count() == 0
    one = langid.fit_language(spark.createDataFrame([(1, "abc def", "en")], df.schema))
    assert langid.predict_language(df, one).where("doc_id = 1").first()["lang_pred"] == "en"


def test_unsure_languages_are_left_out(spark):
    """A text that every machine is undecided on has the lowest score there is, and goes; a sure one stays."""
    row = langid.features("yes")
    model = langid.LanguageModel([["a", "b"], ["c"]], np.append(np.where(row > 0, 9.0, 0.0), 0.0)[None], [np.append(np.where(row > 0, 9.0, 0.0), 0.0)[None], np.empty((0, langid.DIM + 1))])
    df = spark.createDataFrame([(1, "yes"), (2, "quux")], "doc_id long, text string")
    assert {r["doc_id"]: round(r["score"], 2) for r in langid.predict_language(df, model).collect()} == {1: 1.0, 2: 0.25}
    assert [r["doc_id"] for r in langid.filter_language(df, model).collect()] == [1]
    assert langid.filter_language(df, model, min_score=0.25).count() == 2


# ---- tokens ------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return tokens.Counter(public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts_equal_the_library(counter, monkeypatch):
    assert counter.by_word and len(counter.whole) > 5000
    rng = random.Random(4)
    alphabet = list("abcdeéßñ .,\n\t  ▁12<>") + ["the", " of", "<s>", "</s>", "<unk>", "　", "\x00", "日本", "😀", "\r\n"]
    texts = ["", None, " ", "  ", "\n", " \n", "\n\n", "a\n", "\na", "a  b", " a", "a ", "▁", "<0x0A>", "x" * 5000, "the " * 3000]
    texts += ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(1500)]
    want = [len(counter.model.encode(t or "")) for t in texts]
    assert counter.counts(texts) == want
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    assert counter.counts(texts) == want


def test_token_rows(spark, counter):
    import public_tokenizers

    df = spark.createDataFrame([(1, "é the"), (2, None), (2, None), (3, "a " * 5000)], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = tokens.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert [(r["doc_id"], r["n_bytes"], r["over_limit"]) for r in got] == [(1, 6, False), (2, 0, False), (2, 0, False), (3, 10_000, True)]
    assert [r["n_tokens"] for r in got] == [len(counter.model.encode(t)) for t in ("é the", "", "", "a " * 5000)]
    assert tokens.count_tokens(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).collect() == []


# ---- toxicity ----------------------------------------------------------------


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if a == b:
        return True
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[at + 1 :] == b[at + 1 :] or a[at:] == b[at + 1 :] or a[at + 1 :] == b[at:]


def test_automaton_against_edit_distance():
    rng = random.Random(5)
    terms, soft = ["idiot", "scum", "ape$", "idea", "stupid"], {"idiot", "stupid"}
    machine = toxicity.build(terms, soft)
    words = [w for t in ("idiot", "stupid", "scum", "ape", "idea") for _ in range(400) for w in ["".join(mutated(rng, t))] if w]
    text = " ".join(words)
    starts, exact, fuzzy = machine.run(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert len(starts) == len(words)
    for w, e, f in zip(words, exact, fuzzy, strict=True):
        hits = [i + 1 for i, t in enumerate(terms) if (w == t[:-1] if t.endswith("$") else w.startswith(t))]
        assert (e in hits) if hits else e == 0, w
        if not hits:
            assert f == any(distance_at_most_one(w[:k], t) for t in soft for k in range(len(w) + 1)), w


def test_automaton_takes_any_script(spark):
    bold = "".join(chr(0x1D41A + ord(c) - 97) for c in "idiot")
    many = ["".join(chr(0x4E00 + 3 * i + k) for k in range(3)) for i in range(120)]
    machine = toxicity.build([bold, *many], {bold})
    text = f"{bold} x {bold[:-1]} {many[7]} \U0001F600 {many[119]}"
    starts, exact, fuzzy = machine.run(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert exact.tolist() == [1, 0, 0, 9, 121] and fuzzy.tolist()[2]
    rng = random.Random(2)
    rows = [(i, invented(rng, "en", 30) + (f" you {bold}" if i % 2 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(got[i] == i % 2 for i in range(120))


def test_articles_in_odd_markup():
    words = "The first paragraph of the article goes on for a while"
    page = lambda outer, inner: f"<html><body><nav>Home News</nav><div {outer}><p>{words}</p><p>{inner}</p></div><div class='comments'>{words} {words} {words}</div></body></html>"
    for outer in ('class="page has-sidebar"', 'id="content" class="no-sidebar"', 'class="prose [&>p]:mt-4"', 'class="with-comments wide"', 'class="article"'):
        text = html_extract.extract(page(outer, "and ends."), {})
        assert text == f"{words}\n\nand ends.", outer
    inline = 'one <span class="advert">Buy <span>now</span> here</span> two <code><span class="comment"># kept</span></code> three'
    assert html_extract.extract(page('class="a"', inline), {}) == f"{words}\n\none two # kept three"
    open_advert = 'one <b class="ad">Buy'
    assert html_extract.extract(page('class="a"', open_advert) .replace("</p></div>", "</p><p>last</p></div>"), {}) == f"{words}\n\none\n\nlast"
    assert html_extract.extract(page('class="main-sidebar"', "x"), {}) == ""


def mutated(rng, word):
    out = list(word)
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice("abidotszß1"))
        elif at < len(out) and kind == 1:
            out[at] = rng.choice("abidotsz0")
        elif at < len(out) and len(out) > 1:
            del out[at]
    return out + list(rng.choice(["", "", "s", "ic"]))


def test_toxicity_learns_misspelled_and_quoted_terms(spark):
    rng = random.Random(6)
    bad = ["idiot", "moron", "worthless"]
    spell = lambda w: w if rng.random() < 0.6 else w[:2] + rng.choice("xzq") + w[3:]
    docs, labels = [], []
    for i in range(360):
        words = invented(rng, rng.choice(list(STEMS)), 40).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), spell(rng.choice(bad)))
        elif i % 3 == 1:
            at = rng.randrange(len(words))
            words[at:at] = ["“they", "called", rng.choice(bad), "him”"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic), "clash"))
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "x " * 200_000 + "idiot moron worthless")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, None, "x"), (None, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit_toxicity(df.where("doc_id % 2 = 0"), marks)
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    held = [(rows[i]["predicted"], t) for i, t, _ in labels if i % 2]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert rows[900]["score"] == rows[901]["score"] < 0.5
    assert rows[902]["predicted"] == 1
    assert toxicity.score_toxicity(df.limit(0), model).collect() == []


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(df, toxicity.fit_toxicity(df, marks)).collect()
    assert [round(r["score"], 6) for r in got] == [0.0, 0.0]


# ---- quality -----------------------------------------------------------------


def test_sparse_sites_shrink_to_the_prior(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(300):
        junk = i % 3 == 0
        site = "bad" if junk and i % 2 else "good"
        text = "!! | ".join(invented(rng, "en", 30).upper().split()) if junk else invented(rng, "en", 30)
        docs.append((i, text, site, rng.choice("ab")))
        labels.append((i, int(not junk)))
    docs += [(400, docs[0][1], "rare", "a"), (401, None, None, None), (402, "", "good", "a"), (402, "", "good", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, site string, p string").withColumn("quality", F.lit("clash"))
    weights = quality.fit_quality(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = quality.judge_quality(df, weights, F.col("site"), F.col("p")).collect()
    assert len(rows) == len(docs)
    by_id = {r["doc_id"]: r for r in rows}
    assert np.mean([by_id[i]["keep"] == bool(t) for i, t in labels]) > 0.95
    overall = np.mean([r["evidence"] for r in rows])
    bad = next(by_id[i] for i, _, s, _ in docs if s == "bad")
    assert bad["site_rate"] < by_id[400]["site_rate"] < overall + 1e-6
    # By hand: the rates of one site.
    mine = [r["evidence"] for r, d in zip(sorted(rows, key=lambda r: r["doc_id"]), docs) if d[2] == "bad"]
    assert min(mine) - 1e-6 <= bad["site_rate"] <= max(overall, max(mine))


def leaning_sites(rng, n=900):
    """Documents of unclear text on sites that differ, with parts that differ within a site, and single-document sites."""
    shares = {("good", "a"): 0.97, ("good", "b"): 0.9, ("bad", "a"): 0.04, ("bad", "b"): 0.1, ("mixed", "a"): 0.9, ("mixed", "b"): 0.08}
    docs, truth = [], {}
    for i in range(n):
        site, part = rng.choice(list(shares))
        truth[i] = int(rng.random() < shares[site, part])
        words = ["fine" if rng.random() < (0.56 if truth[i] else 0.44) else "junk" for _ in range(12)]
        docs.append((i, " ".join(words), site, part))
    return docs + [(n + i, "fine junk", f"lone{i}", "a") for i in range(10)], truth


def test_quality_posteriors_of_differing_sites_raise_accuracy(spark):
    docs, truth = leaning_sites(random.Random(11))
    df = spark.createDataFrame(docs, "doc_id long, text string, site string, part string")
    marked = spark.createDataFrame([(i, y) for i, y in truth.items() if i % 3], "doc_id long, quality int")
    weights = quality.fit_quality(df, marked)
    rows = {r["doc_id"]: r for r in quality.judge_quality(df, weights, F.col("site"), F.col("part")).collect()}
    assert len(rows) == len(docs)
    held = [i for i in truth if i % 3 == 0]
    alone = sum((rows[i]["evidence"] >= 0.5) == truth[i] for i in held) / len(held)
    joint = sum(rows[i]["keep"] == bool(truth[i]) for i in held) / len(held)
    assert joint > alone + 0.05, (alone, joint)
    # Sparse sites stay near the global share, large ones follow their own documents.
    share = sum(r["evidence"] for r in rows.values()) / len(rows)
    lone = max(abs(r["site_rate"] - share) for i, r in rows.items() if i >= 900)
    assert lone < 1e-6 and all(rows[i]["path_rate"] > share for i, (_, _, s, _) in enumerate(docs[:900]) if s == "good")


def test_quality_posteriors_equal_brute_force(spark):
    docs, _ = leaning_sites(random.Random(12), 150)
    docs += [(7, None, None, None), (7, "", None, "a"), (None, "fine " * 30_000, "good", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, site string, part string")
    rng = np.random.default_rng(3)
    weights = np.append(rng.normal(0, 3, quality.DIM), 0.2)
    rows = quality.judge_quality(df, weights, F.col("site"), F.col("part")).collect()
    p = [1 / (1 + math.exp(-min(max(float(quality.features(t) @ weights[:-1].astype(np.float32) + weights[-1]), -6), 6))) for _, t, _, _ in docs]
    group = [(str(s), str(part)) for _, _, s, part in docs]
    paths, sites = sorted(set(group)), sorted({s for s, _ in group})
    of_path = {g: np.array([v for v, h in zip(p, group) if h == g]) for g in paths}
    of_site = {s: np.array([v for v, h in zip(p, group) if h[0] == s]) for s in sites}
    n, mean = len(p), float(np.mean(p))
    within = sum(((v - v.mean()) ** 2).sum() for v in of_path.values()) / (n - len(paths))
    inner = {s: sum(len(of_path[g]) ** 2 for g in paths if g[0] == s) / len(of_site[s]) for s in sites}
    squares = sum(len(v) * (v.mean() - of_site[g[0]].mean()) ** 2 for g, v in of_path.items())
    between = max((squares - (len(paths) - len(sites)) * within) / (n - sum(inner.values())), 1e-9 * within)
    squares = sum(len(v) * (v.mean() - mean) ** 2 for v in of_site.values())
    noise = (len(sites) - 1) * within + between * (sum(inner.values()) - sum(len(v) ** 2 for v in of_path.values()) / n)
    apart = max((squares - noise) / (n - sum(len(v) ** 2 for v in of_site.values()) / n), 0.0)
    want = []
    for i, (s, part) in enumerate(group):
        left = [j for j in range(n) if j != i and group[j][0] == s]
        shares = {}
        for j in left:
            shares.setdefault(group[j], []).append(p[j])
        z = {g: len(v) / (len(v) + within / between) for g, v in shares.items()}
        told = sum(z[g] * np.mean(v) for g, v in shares.items())
        site_rate = (apart * told + between * mean) / (apart * sum(z.values()) + between)
        own = shares.get((s, part), [])
        path_rate = (sum(own) + within / between * site_rate) / (len(own) + within / between)
        odds = p[i] / (1 - p[i]) * path_rate / (1 - path_rate) * (1 - mean) / mean
        want.append((docs[i][0] is None, docs[i][0] or 0, p[i], site_rate, path_rate, odds / (1 + odds)))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["evidence"], r["site_rate"], r["path_rate"], r["quality"]) for r in rows]
    assert np.allclose(sorted(got), sorted(want), atol=1e-5)


def test_quality_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, site string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    weights = quality.fit_quality(df, none)
    assert quality.judge_quality(df, weights, F.col("site"), F.col("site")).first()["quality"] == 0.5
    assert quality.judge_quality(df.limit(0), weights, F.col("site"), F.col("site")).collect() == []


# ---- pages -------------------------------------------------------------------

SHELL = '<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>{}<div class="ad-box">Buy</div><footer>&copy; me</footer></body></html>'


def test_pages_of_a_template_use_the_path_of_their_host(spark):
    story = "".join(f"<p>Paragraph {i} of the article &amp; more text\n here.</p>" for i in range(5))
    side = "<div class='links7'>" + "".join(f"<p>Plain teaser number {i} without a link that is rather long in this case.</p>" for i in range(9)) + "</div>"
    full = SHELL.format(f'<div class="story-12"><h1>Head</h1>{story}<form>Mail</form><div class="comments">First!</div></div>')
    short = SHELL.format(f'<div class="story-9"><p>Only this.</p></div>{side}')
    pages = [(i, "https://User@Host.example:80/a", full) for i in range(6)] + [(7, "http://host.example/b", short), (8, None, "<p>Bare <b>text</b><br>here<p>Two"), (9, "x", None), (10, "x", ""), (11, "x", "<<<>"), (11, "x", "<!-- only"), (12, "http://h2/", "<article>A" + "<p>" * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit(2))
    rows = html_extract.extract_pages(df).collect()
    assert len(rows) == len(pages)
    got = {r["page_id"]: r["text"] for r in rows}
    assert got[0] == "\n\n".join(["Head", *(f"Paragraph {i} of the article & more text here." for i in range(5))])
    assert got[7] == "Only this."
    assert got[8] == "Bare text here\n\nTwo"
    assert got[9] == got[10] == "" and got[12] == "A"
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert html_extract.extract_pages(df.limit(0)).collect() == []


# ---- mixing ------------------------------------------------------------------


@pytest.mark.parametrize("weights", [{"a": 5.0, "b": 3.0, "c": 1.0, "d": 1.0}, {"a": 1.0, "b": 1.0, "c": 1.0, "d": 97.0}])
def test_every_source_stays_within_one_block(weights):
    quota = mixing.quotas(weights, 100)
    turn = mixing.one_period(quota)
    done = dict.fromkeys(quota, 0)
    for slot, (s, i) in enumerate(turn * 2):
        assert i == done[s] % quota[s]
        done[s] += 1
        assert all(abs(done[k] - quota[k] * (slot + 1) / 100) < 1 for k in quota)


def test_mix_places_every_row_once(spark):
    rows = [(i, "abc"[min(i % 7, 2)], "x") for i in range(700)] + [(i, None, "y") for i in range(700, 730)] + [(5, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    got = mixing.mix(df, {"a": 2.0, "b": 1.0}, block_rows=4, period=10).collect()
    assert len(got) == len(rows) == len({r["place"] for r in got})
    slots = sorted({r["slot"] for r in got})
    assert slots == list(range(len(slots)))
    owner = {}
    for r in got:
        assert owner.setdefault(r["slot"], r["source"]) == r["source"]
        assert r["place"] // 4 == r["slot"]
    order = [owner[s] for s in slots]
    quota = mixing.quotas({"a": 2.0, "b": 1.0, "c": 1.0, "\0null": 1.0}, 10)
    blocks = {s: math.ceil(sum(r[1] == s for r in rows) / 4) for s in ("a", "b", "c", None)}
    assert {s: order.count(s) for s in blocks} == blocks
    # Until the first source runs out, nobody is a block off.
    done = dict.fromkeys(blocks, 0)
    for n, s in enumerate(order):
        if any(done[k] == blocks[k] for k in blocks):
            break
        done[s] += 1
        assert all(abs(done[k] - quota["\0null" if k is None else k] * (n + 1) / 10) < 1 for k in blocks)
    again = mixing.mix(df.repartition(5), {"a": 2.0, "b": 1.0}, block_rows=4, period=10).collect()
    assert sorted((r["doc_id"], r["slot"]) for r in again) == sorted((r["doc_id"], r["slot"]) for r in got)
    assert mixing.mix(df.limit(0)).collect() == []


def lags(blocks, weights, period):
    """Largest distance of any source from its share over all slots."""
    shares = mixing.Shares(blocks, weights)
    done, most, slot = np.zeros(len(blocks), int), 0.0, 0
    for start, before, after in mixing.bounds(blocks, weights, shares, period):
        sid = np.flatnonzero(after > before)
        for s, i in zip(*mixing.deal(start, sid, before[sid], after[sid], weights[sid], shares), strict=True):
            assert i == done[s]
            done[s] += 1
            slot += 1
            most = max(most, np.abs(done - shares.due(slot, blocks, weights)).max())
    assert (done == blocks).all()
    return most


@pytest.mark.parametrize("period", [10, 777, 10**6])
def test_mix_keeps_to_the_weights_themselves(period):
    rng = random.Random(6)
    sizes = np.array([5000] + [rng.randrange(1, 900) for _ in range(20)])
    assert lags(sizes, np.sqrt(sizes), period) < 1.001
    assert lags(np.array([3000, 40, 2000]), np.array([0.6, 0.0005, 0.3995]), period) < 1.001
    # Until the first source is dry the share is the weight of every slot, not a multiple of 1/1000.
    shares = mixing.Shares(np.array([3000, 40, 2000]), np.array([0.6, 0.0005, 0.3995]))
    assert abs(shares.due(4000, np.array([3000, 40, 2000]), np.array([0.6, 0.0005, 0.3995]))[1] - 2.0) < 1e-6


def test_mix_does_not_lift_a_small_weight(spark):
    df = spark.range(5040).selectExpr("id as doc_id", "case when id < 3000 then 'a' when id < 3040 then 'b' else 'c' end as source")
    placed = mixing.mix(df, {"a": 0.6, "b": 0.0005, "c": 0.3995}, block_rows=1)
    got = {r["source"]: r["count"] for r in placed.where("place < 4000").groupBy("source").count().collect()}
    assert all(abs(got[s] - n) < 1 for s, n in {"a": 2400, "b": 2, "c": 1598}.items())


def test_mix_of_many_sources(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 700) as source")
    got = mixing.mix(df, block_rows=2).collect()
    assert len(got) == len({r["doc_id"] for r in got}) == len({r["place"] for r in got}) == 3000


# ---- decontamination ---------------------------------------------------------

ITEM = "A train leaves the old station at 8:30 with 120 people and goes 45 km to meet Anna near the bridge before Anna pays 120 euros for the ticket"


def test_reparameterised_questions_are_caught(spark):
    swapped = ITEM.replace("120", "77").replace("45", "9").replace("Anna", "Boris").replace("8:30", "9:15")
    torn = ITEM.replace("Anna", "Boris", 1).replace("120", "77", 1)
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    docs = [
        (1, f"{filler}. {ITEM}. {filler}"),
        (2, f"{filler}; {swapped} {filler}"),
        (3, f"{filler} {torn} {filler}"),
        (4, filler),
        (5, None),
        (6, ""),
        (7, ITEM.upper()),
        (8, f"{filler} {ITEM[:60]} {filler}"),
        (1, f"{filler}. {ITEM}. {filler}"),
        (9, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, "1 2 3 4 5 6 7 8 9 10 11")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    rows = {r["doc_id"]: r for r in decontam.leaks(df, items).collect()}
    assert {d for d, r in rows.items() if r["contaminated"]} >= {1, 2}
    assert rows[3]["consistent"] is False and rows[3]["contaminated"] is False
    assert not {4, 5, 6, 8, 9} & set(rows)
    assert rows[1]["n_slots"] == rows[2]["n_slots"] > 3
    more = df.union(spark.createDataFrame([(None, ITEM, "x"), (None, filler, "x"), (2, filler, "x")], df.schema))
    assert sorted((r["doc_id"] or 0) for r in decontam.drop_leaks(more, items).collect() if r["text"] == filler) == [0, 2, 4]
    assert not [r for r in decontam.drop_leaks(more, items).collect() if r["text"] == ITEM]
    kept = decontam.drop_leaks(df, items)
    assert kept.columns == df.columns
    assert not {1, 2} & {r["doc_id"] for r in kept.collect()}
    assert {3, 4, 5, 6, 8, 9} <= {r["doc_id"] for r in kept.collect()}
    assert decontam.leaks(df.limit(0), items).collect() == [] == decontam.leaks(df, items.limit(0)).collect()


def test_plain_items_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, invented(rng, rng.choice(list(STEMS)), rng.randrange(15, 50))) for i in range(12)]
    docs = []
    for d in range(60):
        words = invented(rng, rng.choice(list(STEMS)), 80).split()
        if d % 3 == 0:
            part = rng.choice(items)[1].split()
            words[20:20] = part[: rng.choice([8, len(part) // 2 + 8, len(part)])]
        docs.append((d, " ".join(words)))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()}
    want = set()
    for d, t in docs:
        w = re.findall(r"[^\W\d_]+", t)
        have = {}
        for at in range(len(w) - 7):
            have.setdefault(tuple(w[at : at + 8]), []).append(at)
        for i, text in items:
            v = re.findall(r"[^\W\d_]+", text)
            shift = {}
            for at in range(len(v) - 7):
                for x in have.get(tuple(v[at : at + 8]), ()):
                    shift[x - at] = shift.get(x - at, 0) + 1
            if shift and max(shift.values()) >= 0.4 * (len(v) - 7):
                want.add((d, i))
    assert want and got == want
