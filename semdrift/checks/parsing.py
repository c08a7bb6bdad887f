"""Checks of message parsing, headers, filters over parsed events and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.checks import views as W
from semdrift.checks.registry import query, wall
from semdrift.functions import encode
from semdrift.functions import scalars as S
from semdrift.operators import filters, merge, ordering
from semdrift.operators import rollups as R
from semdrift.operators.parse import parse_events
from semdrift.plans import quality, reports
from semdrift.scale import cut, scratch_path
from semdrift.sources.capture import MESSAGE_SCHEMA, envelope_lines, load_events, millis_to_ts, read_capture_jsonl
from semdrift.sources.capture import as_messages, read_capture_stream
from semdrift.sources.vector_store import VectorStore
from semdrift.streaming import ingest
from semdrift.streaming.metrics import read_metrics

ONCE = "oe as (select distinct * from pe)"


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return parse_events(W.capture_raw(spark, d))[0]


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Parsed events, each topic offset once."""
    return parsed(spark, d).dropDuplicates(merge.EVENT_KEY)


# ---- parser ---------------------------------------------------------------


@query(
    "parsed_events",
    "P-01 P-04 P-06 P-07 P-08",
    f"with {W.PARSED} select kafka_topic, kafka_partition, kafka_offset, kafka_ts, request_id, route, session_id, "
    "frame_type, end_of_stream, headers, body, body_size, decision, blocked, warned, prompt_text, completion_text, "
    "cohort, event_id, stream_id, frame_seq, event_ts from pe",
)
def parsed_events(spark: SparkSession, d: str) -> DataFrame:
    events = parsed(spark, d)
    return events.select(
        *[c for c in events.columns if c not in ("headers", "event_json", "prompt_embedding", "completion_embedding",
                                                 "kafka_ts", "event_ts", "source")],
        S.headers_text(F.col("headers")).alias("headers"),
        wall("kafka_ts").alias("kafka_ts"), wall("event_ts").alias("event_ts"),
    )


@query(
    "rejected_messages",
    "P-12",
    f"with {W.FRAMES} select conv_id * 100 + turn as kafka_offset, case conv_id % 11 when 6 then 'malformed json' "
    "else 'headers not an object' end as reason from fr where conv_id % 11 in (6, 10)",
)
def rejected_messages(spark: SparkSession, d: str) -> DataFrame:
    return parse_events(W.capture_raw(spark, d))[1].select("kafka_offset", "reason")


@query(
    "header_lookup",
    "P-02 X-02",
    f"with {W.PARSED} select kafka_offset, case when conv_id % 11 in (0, 1) then route end as path, "
    "case when conv_id % 11 not in (0, 1, 2, 7) then 'application/json' end as content_type from pe",
)
def header_lookup(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("headers")
    return parsed(spark, d).select(
        "kafka_offset", S.header_value(h, ":path").alias("path"), S.header_value(h, "Content-Type").alias("content_type")
    )


@query(
    "route_and_session",
    "P-03",
    f"with {W.PARSED} select route, session_id, count(*) as n from pe group by route, session_id",
)
def route_and_session(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).groupBy("route", "session_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prompt_and_completion",
    "P-05 F-05",
    f"with {W.PARSED} select kafka_offset, prompt_text, completion_text, coalesce(prompt_text <> '', false) as has_prompt, "
    "coalesce(completion_text <> '', false) as has_completion from pe",
)
def prompt_and_completion(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).select(
        "kafka_offset", "prompt_text", "completion_text",
        S.has_text(F.col("prompt_text")).alias("has_prompt"), S.has_text(F.col("completion_text")).alias("has_completion"),
    )


@query(
    "event_times",
    "P-08 P-09 X-01",
    f"with {W.FRAMES} select conv_id * 100 + turn as kafka_offset, event_ts, event_ts as json_ts, event_ts as kafka_ts "
    "from fr where conv_id % 11 <> 6 union all "
    "select conv_id * 100 + turn, event_ts, event_ts, event_ts from fr where conv_id % 11 = 5 "
    "union all select conv_id * 100 + turn, null, null, event_ts from fr where conv_id % 11 = 6",
)
def event_times(spark: SparkSession, d: str) -> DataFrame:
    envelope = F.try_variant_get(F.try_parse_json("value"), "$.timestamp", "string")
    # get_json_object reads broken documents as far as they go, so these are set apart first.
    whole = F.when(F.try_parse_json("value").isNotNull(), F.col("value"))
    return W.capture_raw(spark, d).select(
        "kafka_offset",
        wall(S.event_time(envelope)).alias("event_ts"),
        wall(S.json_time(whole, "$.timestamp")).alias("json_ts"),
        wall(millis_to_ts(F.unix_millis("kafka_ts"))).alias("kafka_ts"),
    )


@query(
    "body_sizes",
    "P-07 X-03",
    f"with {W.FRAMES} select stream_id, turn, strlen(body) as n_bytes from fr",
)
def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    return W.frames(spark, d).select("stream_id", "turn", S.byte_length(F.col("body")).alias("n_bytes"))


@query(
    "text_previews",
    "P-10",
    f"with {W.FRAMES} select request_id, left(body, 200) as p200, left(body, 150) as p150, left(body, 80) as p80 from fr",
)
def text_previews(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    return W.frames(spark, d).select(
        "request_id", *[S.preview(body, n).alias(f"p{n}") for n in (200, 150, 80)]
    )


@query(
    "headers_text",
    "P-11",
    f"""with {W.FRAMES} select stream_id, ':path: ' || any_value(route) || chr(10) || 'X-Session-Id: ' || any_value(session_id)
|| chr(10) || 'x-request-id:' || case when conv_id % 4 <> 0 then ' r-' || cast(conv_id as varchar) else '' end as content
from fr group by stream_id, conv_id""",
)
def headers_text(spark: SparkSession, d: str) -> DataFrame:
    heads = W.headed_frames(spark, d).where(F.col("headers").isNotNull())
    return heads.select("stream_id", S.headers_text(F.col("headers")).alias("content"))


@query(
    "labels_and_prefixes",
    "X-02 X-06 X-09",
    f"""with {W.FRAMES} select request_id, frame_type, 'search_query: ' || body as as_query,
'search_document: ' || body as as_document, lower(trim(body)) as plain, contains(body, 'e') as has_e,
starts_with(body, 'T') as starts_t from fr""",
)
def labels_and_prefixes(spark: SparkSession, d: str) -> DataFrame:
    kind = (
        F.when(F.col("frame_type") == "request_body", "RequestBody")
        .when(F.col("frame_type") == "response_body", "ResponseBody")
        .otherwise("RequestHeader")
    )
    body = F.col("body")
    return W.frames(spark, d).select(
        "request_id", S.frame_type(kind).alias("frame_type"),
        S.prefixed(body, "query").alias("as_query"), S.prefixed(body, "document").alias("as_document"),
        F.lower(F.trim(body)).alias("plain"), F.contains(body, F.lit("e")).alias("has_e"),
        F.startswith(body, F.lit("T")).alias("starts_t"),
    )


# ---- sources, sinks, ingest -----------------------------------------------


@query(
    "capture_lines",
    "S-02",
    # Messages of every 22nd conversation carry the JSON value false as their body.
    f"with {W.FRAMES} select conv_id, turn, case when conv_id % 22 = 11 then 'false' else body end as body "
    "from fr where conv_id % 11 not in (6) union all select conv_id, turn, body from fr where conv_id % 11 = 5",
)
def capture_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    raw = W.capture_raw(spark, d).select("value")
    # Every message is followed by a blank line.
    raw.select(F.explode(F.array("value", F.lit("  "))).alias("value")).write.text(path)
    lines = read_capture_jsonl(spark, path)
    v = F.try_parse_json("value")
    ids = F.split(F.try_variant_get(v, "$.event_id", "string"), "-")
    return envelope_lines(lines).where(v.isNotNull()).select(
        ids[1].cast("bigint").alias("conv_id"), ids[2].cast("bigint").alias("turn"),
        F.try_variant_get(v, "$.body", "string").alias("body"),
    )


@query(
    "idempotent_append",
    "K-01 J-04",
    f"with {W.PARSED}, {ONCE} select kafka_offset, request_id from oe where route <> '/chat'",
)
def idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    batch = parsed(spark, d).select(*merge.EVENT_KEY, "request_id", "route")
    present = batch.where(F.col("route") == "/chat")
    return merge.new_events(batch, present).select("kafka_offset", "request_id")


@query(
    "stored_events",
    "S-03 K-01 R-02",
    f"with {W.PARSED}, {ONCE} select kafka_partition, kafka_offset, request_id, route, prompt_text from oe",
)
def stored_events(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "events")
    batch = cut(parsed(spark, d))
    for _ in range(2):  # the second delivery changes nothing
        ingest.append_events(batch, path)
    return load_events(spark, path, "kafka_partition", "kafka_offset", "request_id", "route", "prompt_text")


def message_files(spark: SparkSession, d: str, files: int = 4) -> str:
    """The messages as JSON files of a file stream."""
    path = scratch_path(spark, "messages")
    raw = W.capture_raw(spark, d).select(
        F.col("kafka_topic").alias("topic"), F.col("kafka_partition").alias("partition"),
        F.col("kafka_offset").alias("offset"), F.col("kafka_ts").alias("timestamp"), "value",
    )
    raw.repartition(files).write.json(path)
    return path


@query(
    "streamed_ingest",
    "S-01 R-01 R-02 D-01",
    f"with {W.PARSED}, {ONCE} select kafka_offset, request_id, route, session_id, coalesce(prompt_text <> '', false) "
    "as prompt_embedded, coalesce(completion_text <> '', false) as completion_embedded from oe",
)
def streamed_ingest(spark: SparkSession, d: str) -> DataFrame:
    messages = read_capture_stream(spark, {"path": message_files(spark, d), "maxFilesPerTrigger": "2"}, "json")
    target = scratch_path(spark, "events")
    run = ingest.run_ingest(
        messages, target, scratch_path(spark, "rejects"), scratch_path(spark, "checkpoint"),
        encode.hashed_encoder(64), trigger={"availableNow": True},
    )
    run.awaitTermination()
    return spark.read.parquet(target).select(
        "kafka_offset", "request_id", "route", "session_id",
        F.col("prompt_embedding").isNotNull().alias("prompt_embedded"),
        F.col("completion_embedding").isNotNull().alias("completion_embedded"),
    )


@query(
    "ingest_metrics",
    "R-04 R-05",
    f"with {W.PARSED} select route, count(*) as received, count_if(event_ts <= timestamp '2024-01-02 12:00:00') as late "
    "from pe where route is not null group by route",
)
def ingest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What the batches of a stream left of their counts, summed over the batches."""
    messages = read_capture_stream(spark, {"path": message_files(spark, d), "maxFilesPerTrigger": "2"}, "json")
    routes = cut(parsed(spark, d).where(F.col("route").isNotNull()).select("route").distinct())
    windows = routes.withColumn("window_end", F.lit("2024-01-02 12:00:00").cast("timestamp_ntz").cast("timestamp"))
    path = scratch_path(spark, "metrics")
    run = ingest.run_ingest(
        messages, scratch_path(spark, "events"), scratch_path(spark, "rejects"), scratch_path(spark, "checkpoint"),
        embed=False, trigger={"availableNow": True}, metrics=path, windows=lambda: windows,
    )
    run.awaitTermination()
    told = read_metrics(spark, path).where(F.col("route").isNotNull())
    return told.groupBy("route").agg(F.sum("received").alias("received"), F.sum("late").alias("late"))


def headed_messages(spark: SparkSession, d: str) -> DataFrame:
    """Captured frames as messages; only the header frame of a stream knows route, session and request id."""
    frames = W.headed_frames(spark, d)
    shown = F.to_json(F.struct("stream_id", "frame_seq", "frame_type", "headers", F.lit("x").alias("body")))
    conv = F.substring_index("stream_id", "-", -1).cast("long")
    return frames.select(
        F.lit("capture").alias("topic"), F.lit(0).alias("partition"), (conv * 1000 + F.col("frame_seq")).alias("offset"),
        F.col("event_ts").cast("timestamp").alias("timestamp"), shown.alias("value"), "frame_seq",
    )


@query(
    "streamed_correlation",
    "J-05 R-01",
    f"""with {W.FRAMES} select conv_id * 1000 + frame_seq as kafka_offset, route, session_id,
case when conv_id % 4 <> 0 then 'r-' || cast(conv_id as varchar) end as request_id
from (select conv_id, frame_seq, route, session_id from fr union all select distinct conv_id, 0, route, session_id from fr)""",
)
def streamed_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Every stream over three batches, its header frame in the second; the third is read after a restart."""
    raw, path = headed_messages(spark, d), scratch_path(spark, "headed")
    seq = F.col("frame_seq")
    parts = [raw.where((seq > 0) & (seq % 2 == 0)), raw.where(seq == 0), raw.where(seq % 2 == 1)]
    target, rejects, checkpoint = (scratch_path(spark, n) for n in ("events", "rejects", "checkpoint"))
    for part in parts:
        part.drop("frame_seq").write.mode("append").json(path)
        messages = read_capture_stream(spark, {"path": path}, "json")
        run = ingest.run_ingest(messages, target, rejects, checkpoint, embed=False, trigger={"availableNow": True}, wait_ms=3_600_000)
        run.awaitTermination()
    return spark.read.parquet(target).select("kafka_offset", "route", "session_id", "request_id")


@query(
    "published_envelopes",
    "K-07",
    f"with {W.PARSED} select event_id, route, body from pe",
)
def published_envelopes(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "published")
    ingest.publish_envelopes(parsed(spark, d).select("event_id", "route", "body"), {"path": path}, "text")
    v = F.parse_json("value")
    return read_capture_jsonl(spark, path).select(
        *[F.try_variant_get(v, f"$.{c}", "string").alias(c) for c in ("event_id", "route", "body")]
    )


@query(
    "embedded_texts",
    "D-01 X-09",
    f"with {W.PARSED}, {ONCE} select kafka_offset, case when prompt_text <> '' then cast(1.0 as double) end as prompt_length, "
    "case when completion_text <> '' then cast(1.0 as double) end as completion_length from oe",
)
def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    vectors = encode.embed_events(stored(spark, d), encode.hashed_encoder())

    def length(col: str):
        return F.round(F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, x: s + x.cast("double") * x)), 4)

    return vectors.select(
        "kafka_offset", length("prompt_embedding").alias("prompt_length"),
        length("completion_embedding").alias("completion_length"),
    )


@query(
    "stored_vectors",
    "D-01 X-09",
    f"with {W.PARSED}, {ONCE}, texts as (select 'query: ' || prompt_text as t from oe where prompt_text <> '' "
    "union all select 'document: ' || completion_text from oe where completion_text <> '') "
    "select count(*) as vectors, count(distinct t) as stored, count(distinct t) as stored_again, count(*) as equal from texts",
)
def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text is encoded once, a second pass encodes none, and the vectors are those of the direct way."""
    events = cut(stored(spark, d).select("kafka_offset", "prompt_text", "completion_text"))
    direct = encode.hashed_encoder(64)
    store = VectorStore(scratch_path(spark, "vectors"), "hashed", direct, buckets=8)

    def long(df: DataFrame, out: str) -> DataFrame:
        kinds = [df.select("kafka_offset", F.lit(k).alias("kind"), F.col(f"{k}_embedding").alias(out)) for k in ("prompt", "completion")]
        return kinds[0].unionByName(kinds[1]).where(F.col(out).isNotNull())

    long(encode.embed_events(events, store), "v").write.format("noop").mode("overwrite").save()
    once = store.stored(spark).count()
    kept = long(encode.embed_events(events, store), "v")
    again = store.stored(spark).count()
    both = kept.join(long(encode.embed_events(events, direct), "w"), ["kafka_offset", "kind"], "left")
    sums = both.agg(F.count("v").alias("vectors"), F.count_if(F.col("v") == F.col("w")).alias("equal"))
    return sums.select("vectors", F.lit(once).alias("stored"), F.lit(again).alias("stored_again"), "equal")


# ---- filters and reports over parsed events -------------------------------


@query(
    "session_events",
    "F-04 F-07",
    f"with {W.PARSED}, {ONCE} select session_id, count(*) as n from oe "
    "where session_id is not null and session_id in (select session_id from oe where blocked) group by session_id",
)
def session_events(spark: SparkSession, d: str) -> DataFrame:
    events = filters.with_session(stored(spark, d))
    chosen = filters.session_filter(events, events.where(F.col("blocked")))
    return chosen.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "session_transcript",
    "M-18",
    f"with {W.PARSED}, {ONCE} select session_id, event_ts, request_id, "
    "case frame_type when 'request_body' then 'user' else 'assistant' end as role, "
    "case frame_type when 'request_body' then prompt_text else completion_text end as content from oe "
    "where (frame_type = 'request_body' and prompt_text <> '') or (frame_type = 'response_body' and completion_text <> '')",
)
def session_transcript(spark: SparkSession, d: str) -> DataFrame:
    return reports.session_transcript(stored(spark, d)).withColumn("event_ts", wall("event_ts"))


@query(
    "turn_index",
    "W-03 F-06",
    f"with {W.PARSED}, {ONCE} select session_id, request_id, row_number() over "
    "(partition by session_id order by event_ts, request_id) - 1 as turn_index from oe where frame_type = 'request_body'",
)
def turn_index(spark: SparkSession, d: str) -> DataFrame:
    turns = filters.prompt_turns(stored(spark, d)).select("session_id", "request_id", "event_ts")
    return ordering.turn_index(turns).drop("event_ts")


@query(
    "session_route",
    "W-04",
    f"with {W.PARSED}, {ONCE} select session_id, min_by(route, {{'t': event_ts, 'r': request_id}}) as route "
    "from oe group by session_id",
)
def session_route(spark: SparkSession, d: str) -> DataFrame:
    return R.session_route(stored(spark, d))


@query(
    "check_cohorts",
    "Q-01",
    f"with {W.PARSED}, {ONCE}, c as (select count_if(cohort = 'drift') as d, count_if(cohort = 'noise') as n, "
    "count_if(cohort = 'normal') as o from oe) select 'all cohorts present' as name, d > 0 and n > 0 and o > 0 as passed, "
    "'drift=' || d || ', noise=' || n || ', normal=' || o as detail from c",
)
def check_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_cohorts(stored(spark, d))


@query(
    "check_no_loss",
    "Q-02",
    f"with {W.PARSED}, {ONCE}, c as (select (select count(*) from oe) as s, (select count(*) from fr) as p) "
    "select 'no ingestion loss' as name, p > 0 and s >= p and s % p = 0 as passed, "
    "s || ' stored, ' || p || ' published' as detail from c",
)
def check_no_loss(spark: SparkSession, d: str) -> DataFrame:
    return quality.check_no_loss(stored(spark, d), W.frames(spark, d))


@query(
    "check_embeddings",
    "Q-03 Q-04",
    f"with {W.PARSED}, {ONCE}, c as (select count_if(frame_type = 'request_body' and prompt_text = '') as p, "
    "count_if(frame_type = 'response_body' and completion_text = '') as q from oe) "
    "select 'prompts are embedded' as name, p = 0 as passed, p || ' rows without a vector' as detail from c "
    "union all select 'completions are embedded', q = 0, q || ' rows without a vector' from c",
)
def check_embeddings(spark: SparkSession, d: str) -> DataFrame:
    events = encode.embed_events(stored(spark, d), encode.hashed_encoder(64))
    return quality.check_prompt_embeddings(events).unionByName(quality.check_completion_embeddings(events))


@query(
    "cohort_counts",
    "A-12",
    f"with {W.PARSED}, {ONCE} select cohort, count(*) as n from oe group by cohort",
)
def cohort_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.cohort_counts(stored(spark, d))


@query(
    "topic_messages",
    "S-01",
    f"with {W.FRAMES} select 'capture' as kafka_topic, cast(conv_id % 3 as integer) as kafka_partition, count(*) as n, "
    "min(conv_id * 100 + turn) as first_offset from (select * from fr union all select * from fr where conv_id % 11 = 5) "
    "group by conv_id % 3",
)
def topic_messages(spark: SparkSession, d: str) -> DataFrame:
    messages = as_messages(spark.read.schema(MESSAGE_SCHEMA).json(message_files(spark, d)))
    return messages.groupBy("kafka_topic", "kafka_partition").agg(
        F.count(F.lit(1)).alias("n"), F.min("kafka_offset").alias("first_offset")
    )


