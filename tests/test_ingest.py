import datetime as dt
import json

from pyspark.sql import functions as F

from semdrift.checks.registry import COVERS, QUERIES, SQL
from semdrift.functions import encode
from semdrift.functions import scalars as S
from semdrift.operators import filters
from semdrift.operators.parse import events_of, parse_events, parse_messages, rejects_of
from semdrift.plans import quality
from semdrift.sources.capture import read_capture_stream
from semdrift.streaming import ingest, offsets

TS = dt.datetime(2024, 1, 1, 12)
MESSAGES = "kafka_topic string, kafka_partition int, kafka_offset long, kafka_ts timestamp, value string"


def messages(spark, values):
    rows = [("t", 0, i, TS, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, MESSAGES)


def parse_one(spark, envelope):
    events, _ = parse_events(messages(spark, [envelope]))
    return events.first()


def test_empty_values_count_as_missing(spark):
    r = parse_one(spark, {"route": "", "headers": {":PATH": "", "X-Envoy-Original-Path": "/p"}, "session_id": " "})
    assert (r["route"], r["session_id"], r["frame_type"], r["body"]) == ("/p", " ", "unknown", "")
    r = parse_one(spark, {"frame_type": "request_body", "body": "b", "prompt": "", "completion": "c"})
    assert (r["prompt_text"], r["completion_text"], r["headers"]) == ("b", "c", {})
    r = parse_one(spark, {"frame_type": "response_body", "headers": None, "body": None})
    assert (r["prompt_text"], r["completion_text"], r["body_size"]) == (None, "", 0)


def test_decisions_sizes_and_truthiness(spark):
    assert parse_one(spark, {})["decision"] == "Unknown"
    assert parse_one(spark, {"decision": None})["decision"] is None
    assert parse_one(spark, {"body": "é"})["body_size"] == 2
    assert parse_one(spark, {"body": "é", "body_size": "7"})["body_size"] == 7
    truth = [(True, True), (False, False), (0, False), (2, True), ("", False), ("no", True), (None, False), ([], False), ([0], True), ({}, False)]
    for value, want in truth:
        assert parse_one(spark, {"blocked": value})["blocked"] is want, value


def test_every_message_is_event_or_reject(spark):
    batch = messages(spark, [{"a": 1}, "{broken", "[1]", "3", {"headers": "x"}, {"headers": []}, {"body_size": None}, {"body_size": "x"}])
    events, rejects = parse_events(batch)
    assert sorted(r["kafka_offset"] for r in events.collect()) == [0, 5]
    assert {r["kafka_offset"]: r["reason"] for r in rejects.collect()} == {
        1: "malformed json", 2: "not an object", 3: "not an object", 4: "headers not an object", 6: "bad body_size",
        7: "bad body_size",
    }


def test_kept_messages_split_into_the_same_events_and_rejects(spark):
    values = [{"a": 1, "body": "b"}, "{broken", "[1]", {"headers": "x"}, {"body_size": 1e12}, {"body_size": None}, {"route": "/r", "headers": {"x": "y"}}]
    batch = messages(spark, values).unionByName(spark.createDataFrame([("t", 1, 1, None, None)], MESSAGES))
    kept = parse_messages(batch)
    for got, want in zip((events_of(kept), rejects_of(kept)), parse_events(batch), strict=True):
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert rejects_of(kept).count() == 6


def test_a_batch_is_parsed_once(spark, tmp_path, monkeypatch):
    """Events, rejects and counts are read from one table that is kept."""
    seen = []
    for name in ("parse_messages", "events_of", "rejects_of"):
        real = getattr(ingest, name)
        monkeypatch.setattr(ingest, name, lambda df, real=real, name=name: (seen.append((name, df.is_cached)), real(df))[1])
    source = tmp_path / "in"
    rows = [("t", 0, i, TS, json.dumps({"route": "/a"}) if i else "{bad") for i in range(4)]
    spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp timestamp, value string").write.json(str(source))
    stream = read_capture_stream(spark, {"path": str(source)}, "json")
    paths = [str(tmp_path / n) for n in ("events", "rejects", "checkpoint")]
    ingest.run_ingest(stream, *paths, embed=False, trigger={"availableNow": True}, metrics=str(tmp_path / "metrics")).awaitTermination()
    assert seen == [("parse_messages", False), ("events_of", True), ("rejects_of", True)]
    assert spark.read.parquet(paths[0]).count() == 3 and spark.read.parquet(paths[1]).count() == 1
    assert {r["route"]: (r["received"], r["rejected"]) for r in spark.read.parquet(str(tmp_path / "metrics")).collect()} == {"/a": (3, 0), None: (0, 1)}


def test_event_times(spark):
    rows = [("2024-01-01T10:00:00+02:00",), ("2024-01-01T08:00:00.123456Z",), ("soon",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(S.event_time(F.col("t")).cast("timestamp_ntz")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 8, 0, 0, 123456), None, None]


def test_stream_equals_batch_and_redelivery_changes_nothing(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "events")
    source.mkdir()
    for f in range(3):
        lines = []
        for i in range(4):
            offset = f * 2 + i  # files overlap by two offsets
            env = json.dumps({"request_id": f"r{offset}", "frame_type": "request_body", "body": f"text {offset}" if offset else "", "timestamp": "2024-01-01T00:00:00Z"})
            lines.append(json.dumps({"topic": "t", "partition": 0, "offset": offset, "timestamp": "2024-01-01T00:00:00Z", "value": env}))
        lines.append(json.dumps({"topic": "t", "partition": 1, "offset": f, "timestamp": "2024-01-01T00:00:00Z", "value": "{bad"}))
        (source / f"{f}.json").write_text("\n".join(lines))

    def run(checkpoint):
        stream = read_capture_stream(spark, {"path": str(source), "maxFilesPerTrigger": "1"}, "json")
        query = ingest.run_ingest(
            stream, target, str(tmp_path / "rejects"), str(tmp_path / checkpoint), encode.hashed_encoder(16),
            trigger={"availableNow": True},
        )
        query.awaitTermination()

    run("c1")
    first = sorted(r["kafka_offset"] for r in spark.read.parquet(target).collect())
    assert first == list(range(8))
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 3
    run("c2")  # a lost checkpoint delivers everything again
    stored = spark.read.parquet(target)
    assert sorted(r["kafka_offset"] for r in stored.collect()) == first
    # Empty text is not embedded.
    assert stored.where("prompt_embedding is null").count() == stored.where("kafka_offset = 0").count() == 1
    assert quality.check_prompt_embeddings(stored).first()["passed"] is False
    assert filters.embedded_events(stored.withColumn("route", F.lit("/a"))).count() == 7


def test_stream_dedupe_within_watermark(spark, tmp_path):
    rows = [("t", 0, i % 5, TS, "{}") for i in range(15)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "topic string, partition int, offset long, timestamp timestamp, value string").write.json(source)
    stream = ingest.dedupe_stream(read_capture_stream(spark, {"path": source}, "json"))
    out = str(tmp_path / "out")
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert sorted(r["kafka_offset"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]


def test_embedding_is_normalized_prefixed_and_pluggable(spark):
    df = spark.createDataFrame([("hello there",), ("",), (" ",), (None,)], "t string")
    got = [r["v"] for r in encode.embed_text(df, "t", "v", "query", encode.hashed_encoder(32)).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-5 and got[1] is None and got[2] is not None and got[3] is None
    model = encode.model_encoder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    got = [r["v"] for r in encode.embed_text(df, "t", "v", "document", model).collect()]
    assert got[0] == [len("search_document: hello there"), 1.0] and got[1] is None


def test_sampling_keeps_streams_whole(spark):
    df = spark.range(4000).select((F.col("id") % 400).cast("string").alias("stream_id"))
    assert filters.sample_streams(df, -1).count() == 0 and filters.sample_streams(df, 2).count() == 4000
    kept = filters.sample_streams(df, 0.5).groupBy("stream_id").count()
    assert {r["count"] for r in kept.collect()} == {10} and 120 < kept.count() < 280


def test_settled(spark):
    def counts(**kw):
        return spark.createDataFrame(list(kw.items()), "route string, n long")

    def settled(a, b):
        return quality.is_settled(a, b).first()["settled"]

    assert settled(counts(a=1), counts(a=1)) is True
    assert settled(counts(a=1), counts(a=2)) is False
    assert settled(counts(a=1), counts(a=1, b=1)) is False
    assert settled(counts(), counts(a=1)) is False and settled(counts(a=1), counts()) is False
    assert settled(counts(a=1, gone=3), counts(a=1)) is True


def test_loss_check_without_published_rows(spark):
    rows = spark.range(3)
    assert quality.check_no_loss(rows, rows).first()["passed"] is True
    assert quality.check_no_loss(rows.union(rows), rows).first()["passed"] is True
    assert quality.check_no_loss(rows, spark.range(2)).first()["passed"] is False
    assert quality.check_no_loss(rows, spark.range(0)).first()["passed"] is False


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) >= 90
    assert set(COVERS) == set(QUERIES) and set(SQL) <= set(QUERIES)


def test_frames_wait_for_their_header_frame(spark, tmp_path):
    """Streams over several batches and runs; one never gets its header frame and goes on after the wait."""

    def run(offset, envelopes, wait_ms):
        rows = [("t", 0, offset + i, TS, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(envelopes)]
        df = spark.createDataFrame(rows, MESSAGES).withColumnsRenamed({"kafka_topic": "topic", "kafka_partition": "partition", "kafka_offset": "offset", "kafka_ts": "timestamp"})
        df.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        source = read_capture_stream(spark, {"path": str(tmp_path / "in")}, "json")
        ingest.run_ingest(source, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp"), embed=False, trigger={"availableNow": True}, wait_ms=wait_ms).awaitTermination()
        return {r["kafka_offset"]: (r["route"], r["session_id"], r["request_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    body = lambda stream, seq: {"stream_id": stream, "frame_seq": seq, "frame_type": "request_body", "body": "b"}
    head = {"stream_id": "s1", "frame_seq": 0, "frame_type": "request_headers", "headers": {":path": "/p", "X-Session-Id": "one", "x-request-id": "r1"}}
    full = {**body("s3", 4), "route": "/own", "session_id": "mine", "request_id": "r3"}
    first = run(0, [body("s1", 2), body("s2", 1), full, {"body": "no stream"}, "{broken"], 60_000)
    assert first == {2: ("/own", "mine", "r3"), 3: (None, None, None)}
    second = run(10, [{**body("s1", 1), "route": "/other"}, head], 60_000)
    assert {k: v for k, v in second.items() if k not in first} == {0: ("/p", "one", "r1"), 10: ("/other", "one", "r1"), 11: ("/p", "one", "r1")}
    third = run(20, [body("s1", 3), body("s4", 1)], 1)
    assert third[20] == ("/p", "one", "r1")
    last = run(30, [body("s5", 1)], 1)
    assert last[21] == (None, None, None)
    rejected = spark.read.parquet(str(tmp_path / "bad"))
    assert rejected.count() == 1


def test_offsets_are_kept_as_intervals(spark, tmp_path, monkeypatch):
    """Gaps, repeats, bucket borders, null offsets and a writer that dies between its two writes."""
    monkeypatch.setattr(offsets, "BUCKET_BITS", 3)
    path = str(tmp_path / "events")

    def rows(pairs, note):
        return spark.createDataFrame([("t", p, o, TS, None, note) for p, o in pairs], "kafka_topic string, kafka_partition int, kafka_offset long, kafka_ts timestamp, prompt_embedding array<float>, note string")

    def stored():
        return sorted((r["kafka_partition"], r["kafka_offset"], r["note"]) for r in spark.read.parquet(path).where("kafka_offset is not null").collect())

    def kept():
        return sorted((r["kafka_partition"], r["low"], r["high"]) for r in offsets.OffsetTable(spark, path).intervals().collect())

    ingest.append_events(rows([(0, 1), (0, 2), (0, 2), (0, 5), (1, 7), (1, 8), (1, 9)], "a"), path)
    assert kept() == [(0, 1, 2), (0, 5, 5), (1, 7, 7), (1, 8, 9)]
    ingest.append_events(rows([(0, 2), (0, 3), (0, 4), (0, 6), (1, 30), (2, 2)], "b"), path)
    assert kept() == [(0, 1, 6), (1, 7, 7), (1, 8, 9), (1, 30, 30), (2, 2, 2)]
    want = [(0, 1, "a"), (0, 2, "a"), (0, 5, "a"), (1, 7, "a"), (1, 8, "a"), (1, 9, "a"), (0, 3, "b"), (0, 4, "b"), (0, 6, "b"), (1, 30, "b"), (2, 2, "b")]
    assert stored() == sorted(want)
    ingest.append_events(rows([(0, 2), (0, 3), (0, 4), (0, 6), (1, 30), (2, 2)], "again"), path)
    assert stored() == sorted(want)
    # The second version is never written.
    write = offsets.OffsetTable.write
    monkeypatch.setattr(offsets.OffsetTable, "write", lambda self, found, begun: write(self, found, begun) if begun else 1 / 0)
    try:
        ingest.append_events(rows([(0, 10), (0, 11)], "c"), path)
    except ZeroDivisionError:
        pass
    monkeypatch.setattr(offsets.OffsetTable, "write", write)
    assert offsets.OffsetTable(spark, path).begun is not None
    ingest.append_events(rows([(0, 10), (0, 11), (0, 12)], "d"), path)
    assert stored() == sorted([*want, (0, 10, "c"), (0, 11, "c"), (0, 12, "d")])
    assert (0, 10, 12) in kept() and offsets.OffsetTable(spark, path).begun is None
    ingest.append_events(rows([(0, None), (0, 12)], "none"), path)
    assert spark.read.parquet(path).where("note = 'none'").count() == 1
    for _ in range(3):
        ingest.append_events(rows([], "empty"), path)
    assert len(list((tmp_path / "events" / "_offsets").glob("v=*"))) <= offsets.KEPT_VERSIONS + 1


def test_a_batch_of_many_dates_leaves_few_files(spark, tmp_path):
    """No more files than dates and tasks, whatever tasks the rows of a date come from."""
    ts = F.timestamp_seconds(1_704_067_200 + 86_400 * (F.col("id") % 40))
    rows = spark.range(0, 400, 1, 8).select(F.lit("t").alias("kafka_topic"), F.lit(0).alias("kafka_partition"), F.col("id").alias("kafka_offset"), ts.alias("kafka_ts"), F.lit(None).cast("array<float>").alias("prompt_embedding"))
    ingest.append_events(rows, str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 400
    assert len(list((tmp_path / "events").glob("batch=*/kafka_date=*/*.parquet"))) <= 40 + 4


def dated_rows(spark, low, high):
    ts = F.timestamp_seconds(1_704_067_200 + 86_400 * (F.col("id") % 40))
    return spark.range(low, high, 1, 8).select(F.lit("t").alias("kafka_topic"), F.lit(0).alias("kafka_partition"), F.col("id").alias("kafka_offset"), ts.alias("kafka_ts"), F.lit(None).cast("array<float>").alias("prompt_embedding"))


def test_files_of_a_batch_follow_its_tasks_not_its_dates(spark, tmp_path):
    path = str(tmp_path / "events")
    ingest.append_events(dated_rows(spark, 0, 400), path)
    ingest.append_events(dated_rows(spark, 0, 600), path)
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("kafka_offset").distinct().count() == 600
    assert stored.where("kafka_date <> to_date(kafka_ts)").count() == 0 and stored.select("kafka_date").distinct().count() == 40
    assert 2 <= len(list((tmp_path / "events").glob("batch=*/**/*.parquet"))) <= 8


def test_a_store_with_a_folder_per_date_goes_on_with_them(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = dated_rows(spark, 0, 80).withColumns({"kafka_date": F.to_date("kafka_ts"), "has_prompt_embedding": F.lit(False)})
    rows.limit(0).write.partitionBy("kafka_date").parquet(f"{path}/batch=a")
    rows.write.partitionBy("kafka_date").parquet(f"{path}/batch=b")
    table = offsets.OffsetTable(spark, path)
    table.write(offsets.intervals_of(rows), None)
    ingest.append_events(dated_rows(spark, 0, 120), path)
    stored = spark.read.parquet(path)
    assert sorted(r["kafka_offset"] for r in stored.collect()) == list(range(120))
    assert stored.where("kafka_date = to_date(kafka_ts)").count() == 120


def test_streams_share_a_call_but_keep_deadlines_of_their_own():
    """One call takes the frames of many streams; a silent one among them goes on when its own wait is over."""
    import pandas as pd

    from semdrift.streaming.correlate import _step

    class State:
        kept, hasTimedOut, timer, passed = None, False, None, 0
        exists = property(lambda self: self.kept is not None)
        get = property(lambda self: self.kept)
        update = lambda self, new: setattr(self, "kept", new)
        remove = lambda self: setattr(self, "kept", None)
        setTimeoutTimestamp = lambda self, ms: setattr(self, "timer", ms)
        getCurrentWatermarkMs = lambda self: self.passed

    def frames(at, *rows):
        names = ["stream_id", "frame_type", "frame_seq", "route", "kafka_offset"]
        return pd.DataFrame(rows, columns=names).assign(kafka_topic="t", kafka_partition=0, micros=0, value="v", session_id=None, request_id=None, arrived_ms=at)

    def call(at, *rows):
        state.passed, state.hasTimedOut = at, not rows
        out = [r for df in step((0,), iter([frames(at, *rows)] if rows else []), state) for r in zip(df["kafka_offset"], df["stream_route"], strict=True)]
        return sorted(out)

    state, step = State(), _step(100, 1000)
    assert call(1000, ("a", "request_body", 1, None, 1), ("b", "request_body", 1, "/b", 2)) == [] and state.timer == 1100
    assert call(1050, ("a", "request_headers", 0, "/a", 3), ("c", "request_body", 1, None, 4)) == [(1, "/a"), (3, "/a")]
    assert state.timer == 1100
    assert call(1120, ("a", "request_body", 2, None, 5)) == [(2, "/b"), (5, "/a")] and state.timer == 1150
    assert call(1160) == [(4, None)] and state.timer == 2120
    assert call(5000) == [] and state.kept is None
