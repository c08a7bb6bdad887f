"""The stages one after the other, each against a brute-force version."""

import random

from test_pairs import brute_groups, brute_repeats
from test_texts import STEMS, invented

import corpus_pipeline
from semdrift.llm import langid


def write(df, path):
    df.write.mode("overwrite").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    items = [(i, invented(rng, "en", 30)) for i in range(3)]
    passage = ". ".join(invented(rng, "en", 12).capitalize() for _ in range(5)) + "."
    rows = []
    for d in range(120):
        lang = rng.choice(list(STEMS))
        text = ". ".join(invented(rng, lang, 14).capitalize() for _ in range(6)) + "."
        if d % 10 == 3:
            text = passage + "\n" + text
        if d % 17 == 5:
            text += " " + items[d % 3][1]
        rows.append((d, text, lang, f"s{d % 4}", len(text)))
    for d in range(120, 140):
        rows.append((d, rows[d - 120][1] + " tail", rows[d - 120][2], "s0", 1))
    rows += [(200, None, "en", "s1", 0), (201, "", "en", None, 0), (202, "12 34", None, "s2", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    docs = write(spark.createDataFrame(rows, schema), f"{folder}/documents.parquet")
    write(spark.createDataFrame(items, "item_id long, text string"), f"{folder}/benchmark.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(write(stage(spark, steps[-1], folder), f"{folder}/{name.replace(' ', '_')}"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert steps[-1].columns == docs.columns
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps]
    assert set(texts[0]) - set(texts[1]) == {200, 201, 202}
    _, groups = brute_groups(list(texts[1].items()), 5, 80)
    assert set(texts[2]) == {d for d in texts[1] if groups[d] == d}
    assert texts[3] == brute_repeats(list(texts[2].items()), 25)
    leaked = {d for d, t in texts[3].items() if any(text in t for _, text in items)}
    assert leaked and set(texts[4]) == set(texts[3]) - leaked
    assert set(texts[5]) == set(texts[4])
    ran = {r["doc_id"]: r["place"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert ran == {r["doc_id"]: r["place"] for r in steps[-1].collect()}
    assert langid.UND not in {r["lang"] for r in steps[1].collect()}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    write(spark.createDataFrame([], schema), f"{tmp_path}/documents.parquet")
    write(spark.createDataFrame([], "item_id long, text string"), f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
