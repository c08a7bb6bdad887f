import gzip
import random

import pytest
from pyspark.sql import functions as F

from semdrift.operators import frames as FR
from semdrift.operators import ordering


def test_running_total_in_ranges_equals_plain_window(spark):
    # One group holds most rows, so it spans many tasks.
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        F.col("id").alias("t"), (F.col("id") % 13).alias("v"),
    ).repartition(6)
    plain = ordering.running_total(df, ["k"], [F.col("t")], F.col("v"), "s")
    ranged = ordering.running_total(df, ["k"], [F.col("t")], F.col("v"), "s", group_rows=50)
    assert ranged.columns == plain.columns
    assert plain.exceptAll(ranged).isEmpty() and ranged.exceptAll(plain).isEmpty()
    null_key = df.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    a = ordering.position(null_key, ["k"], [F.col("t")], "n")
    b = ordering.position(null_key, ["k"], [F.col("t")], "n", group_rows=50)
    assert a.exceptAll(b).isEmpty()


def sse(spark, chunks, **kw):
    rows = [(s, i, c) for s, parts in chunks.items() for i, c in enumerate(parts)]
    df = spark.createDataFrame(rows, "stream_id string, frame_seq long, body string").repartition(3)
    return {r["stream_id"]: (r["content"], r["reasoning"]) for r in FR.assemble_sse(df, **kw).collect()}


@pytest.mark.parametrize("group_rows", [10**6, 1])
def test_streamed_answers(spark, group_rows):
    delta = 'data: {"choices":[{"delta":{"%s":"%s"}}]}\n'
    got = sse(
        spark,
        {
            "split": [(delta % ("content", "Hel"))[:20], (delta % ("content", "Hel"))[20:] + ": note\n\n", delta % ("content", "lo")],
            "kinds": [delta % ("reasoning_content", "a") + delta % ("reasoning", "b"), delta % ("content", "c") + "data: [DONE]\n"],
            "broken": ["data: {oops\n", "event: x\n" + delta % ("content", "ok")],
            "open": [delta % ("content", "kept"), (delta % ("content", "lost")).rstrip("\n")],
            "none": ["no data here"],
            "crlf": [(delta % ("content", "x")).replace("\n", "\r\n")],
        },
        group_rows=group_rows,
    )
    assert got == {
        "split": ("Hello", ""), "kinds": ("c", "ab"), "broken": ("ok", ""), "open": ("kept", ""), "none": ("", ""),
        "crlf": ("x", ""),
    }


def test_lines_inside_a_chunk_are_not_sent_on(spark, monkeypatch):
    """Any cutting gives the same answer, and of a chunk only its first and last piece go into the shuffle."""
    delta = 'data: {"choices":[{"delta":{"%s":"%s"}}]}\n'
    text = "".join(delta % ("reasoning" if i % 3 == 2 else "content", f"w{i} ") + ("\n: ping\r\n" if i % 2 else "  data: {broken\n") for i in range(40))
    text += "data: [DONE]\n" + (delta % ("content", "lost")).rstrip("\n")
    want = tuple("".join(f"w{i} " for i in range(40) if (i % 3 == 2) is odd) for odd in (False, True))
    sent = []
    total = FR.running_total
    monkeypatch.setattr(FR, "running_total", lambda df, *a: sent.append(df) or total(df, *a))
    sizes = [1, 7, 50, 200, 900, 10_000]
    got = sse(spark, {str(n): [text[i : i + n] for i in range(0, len(text), n)] for n in sizes})
    assert got == {str(n): want for n in sizes}
    assert sent[0].agg(F.max(F.size("pieces"))).first()[0] == 2


def test_unstreamed_answers(spark):
    rows = [("a", '{"choices":[{"message":{"content":"hi","reasoning":"why"}}]}'), ("b", "{}"), ("c", "not json")]
    df = spark.createDataFrame(rows, "stream_id string, body string")
    got = {r["stream_id"]: (r["content"], r["reasoning"]) for r in FR.assemble_json(df).collect()}
    assert got == {"a": ("hi", "why"), "b": ("", "")}


def test_gzip_bodies(spark):
    data = gzip.compress(b"hello hello hello " * 50)
    two = gzip.compress(b"one") + gzip.compress(b"two")
    third = len(data) // 3
    rows = [
        ("ok", 0, " GZIP", data[:third], False), ("ok", 1, "gzip", data[third : 2 * third], False),
        ("ok", 2, "gzip", data[2 * third :], True),
        ("members", 0, "gzip", two, True),
        ("cut", 0, "gzip", data[:third], True),
        ("bad", 0, "gzip", b"plain", False), ("bad", 1, "gzip", b"text", True),
        ("other", 0, "br", b"raw", True), ("none", 0, None, b"raw", True),
    ]
    df = spark.createDataFrame(
        rows, "stream_id string, frame_seq long, encoding string, body binary, end_of_stream boolean"
    ).repartition(4)
    got: dict = {}
    for r in sorted(FR.decode_bodies(df).collect(), key=lambda r: r["frame_seq"]):
        got[r["stream_id"]] = got.get(r["stream_id"], b"") + bytes(r["body"])
    assert got == {
        "ok": b"hello hello hello " * 50, "members": b"onetwo", "cut": data[:third], "bad": b"plaintext",
        "other": b"raw", "none": b"raw",
    }


def test_verdicts(spark):
    rows = [
        ("request_body", "x MALICIOUS-req-body bypass-req-body"), ("request_body", "bypass-REQ-body"),
        ("request_body", "malicious-server"), ("response_body", "malicious-server"),
        ("request_headers", "a: malicious-req-head"), ("response_headers", "bypass-res-head"),
        ("unknown", "malicious-req-body"), ("request_body", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, frame_type string, content string")
    got = FR.inspect(df, FR.keyword_rules(spark)).orderBy("i").collect()
    assert [r["decision"] for r in got] == ["Block", "Warn", "Safe", "Block", "Block", "Warn", "Safe", "Safe"]
    assert got[0]["rule_message"] == "keyword 'malicious-req-body' detected"
    assert (got[0]["blocked"], got[0]["warned"], got[1]["warned"], got[2]["rule_message"]) == (True, False, True, None)


def test_correlation_keeps_own_values(spark):
    rows = [
        ("s", 0, "/llm", "sess", ""), ("s", 1, None, None, None), ("s", 2, "/own", "", "r9"), ("t", 1, None, None, None),
    ]
    df = spark.createDataFrame(rows, "stream_id string, frame_seq long, route string, session_id string, request_id string")
    got = {(r["stream_id"], r["frame_seq"]): (r["route"], r["session_id"], r["request_id"]) for r in FR.correlate_frames(df).collect()}
    assert got == {
        ("s", 0): ("/llm", "sess", "r9"), ("s", 1): ("/llm", "sess", "r9"), ("s", 2): ("/own", "sess", "r9"),
        ("t", 1): (None, None, "t"),
    }


def test_context(spark):
    rows = [
        (1, 0, "system", " be kind "), (1, 1, "user", "hi"), (1, 2, "assistant", ""), (1, 3, "user", "again"),
        (1, 4, "assistant", "yes"), (1, 5, "user", "more"), (2, 0, "user", "solo"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): [(m["role"], m["content"]) for m in r["messages"]] for r in FR.build_context(df).collect()}
    assert got[1, 5] == [("system", "be kind"), ("user", "hi"), ("user", "again"), ("assistant", "yes"), ("user", "more")]
    assert got[2, 0] == [("user", "solo")]
    for limit in (10**6, 1):
        spans = {(r["conv_id"], r["turn"]): (r["n_messages"], r["n_bytes"]) for r in FR.context_spans(df, limit).collect()}
        assert spans == {k: (len(v), sum(len(c) for _, c in v)) for k, v in got.items()}


def test_many_rules_equal_few(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdE é") for _ in range(n))
    kinds = ["request_body", "response_body", "other", None]
    rows = [(i, rng.choice(kinds), None if i % 17 == 0 else word(rng.randrange(60)), "clash") for i in range(400)]
    frames = spark.createDataFrame(rows, "i int, frame_type string, content string, rules string")
    rules = [(rng.choice(kinds[:2]), word(rng.randrange(2, 7)), rng.choice(["Block", "Warn"])) for _ in range(300)]
    rules += [("request_body", None, "Block"), (None, "a", "Block"), ("response_body", "ab", None), ("response_body", "ab", "Warn"), (rules[0][0], rules[0][1], "Block")]
    for more in ([], [("request_body", "", "Warn")]):
        table = spark.createDataFrame(rules + more, "frame_type string, pattern string, action string")
        few, many = (FR.inspect(frames, table, many=n).orderBy("i").collect() for n in (10**9, 10))
        assert [r for r in zip(few, many, strict=True) if r[0] != r[1]] == []
        assert len(few) == 400 and {r["decision"] for r in few} >= {"Block", "Safe"}
        assert few[0].asDict().keys() == {"i", "frame_type", "content", "rules", "decision", "blocked", "warned", "rule_message"}
    assert {r["decision"] for r in FR.inspect(frames, table.limit(0)).collect()} == {"Safe"}
