"""Capture traffic derived from the supplied tables, for Spark and, as text, for the SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# ---- prompts with vectors -------------------------------------------------


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a prompt turn; its vector is picked by event id, so vectors repeat."""
    events, vectors = table(spark, sf_dir, "events"), table(spark, sf_dir, "embeddings")
    count = vectors.count()  # from the file footers
    turns = events.withColumn("vec_id", F.col("event_id") % count).join(vectors, "vec_id")
    cohort = F.when(F.col("label") < 7, "normal").when(F.col("label") < 9, "drift").otherwise("noise")
    return turns.select(
        text("req-", "event_id").alias("request_id"),
        F.col("event_type").alias("route"),
        text("u-", "user_id").alias("session_id"),
        F.lit("request_body").alias("frame_type"),
        F.col("ts").alias("event_ts"),
        F.col("ts").alias("kafka_ts"),
        F.col("event_id").alias("kafka_offset"),
        F.col("props").alias("prompt_text"),
        F.col("embedding").alias("prompt_embedding"),
        cohort.alias("cohort"),
    )


SCORED_EVENTS = """
nv as materialized (select count(*) as n from embeddings),
ev as materialized (select *, event_id % n as vec_id from events, nv),
se as materialized (
  select 'req-' || cast(e.event_id as varchar) as request_id, e.event_type as route,
         'u-' || cast(e.user_id as varchar) as session_id, 'request_body' as frame_type,
         e.ts as event_ts, e.ts as kafka_ts, e.event_id as kafka_offset, e.props as prompt_text,
         cast(v.embedding as double[]) as prompt_embedding,
         case when v.label < 7 then 'normal' when v.label < 9 then 'drift' else 'noise' end as cohort
  from ev e join embeddings v using (vec_id)
)"""


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    mean = long.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return mean.groupBy(text("label-", "label").alias("query_id")).agg(packed.alias("p")).select(
        "query_id", F.col("p.m").alias("vector")
    )


LABEL_QUERIES = """
qv as materialized (
  select 'label-' || cast(label as varchar) as query_id, list(m order by pos) as vector
  from (select label, pos, avg(cast(embedding[pos] as double)) as m
        from (select label, embedding, unnest(range(1, len(embedding) + 1)) as pos from embeddings)
        group by label, pos)
  group by label
)"""


def one_query(spark: SparkSession, sf_dir: str, query_id: str) -> list[float]:
    return label_queries(spark, sf_dir).where(F.col("query_id") == query_id).first()["vector"]


# ---- frames with text -----------------------------------------------------


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as captured frames, some with rule keywords."""
    conv, turn = F.col("conv_id"), F.col("turn")
    minutes = (conv * 60 + turn) * 60_000_000
    suffix = (
        F.when((F.col("role") == "user") & (conv % 10 == 0), " MALICIOUS-req-body")
        .when((F.col("role") == "assistant") & (conv % 7 == 0), " bypass-server")
        .otherwise("")
    )
    start = 1_704_067_200_000_000  # 2024-01-01 00:00:00
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        text("conv-", "conv_id").alias("stream_id"),
        F.concat_ws("-", F.lit("req"), conv, turn).alias("request_id"),
        text("sess-", "conv_id").alias("session_id"),
        F.when(conv % 3 == 0, "/llm").when(conv % 3 == 1, "/chat").otherwise("/tools").alias("route"),
        F.when(F.col("role") == "user", "request_body")
        .when(F.col("role") == "assistant", "response_body")
        .otherwise("request_headers")
        .alias("frame_type"),
        (turn + 1).alias("frame_seq"),
        F.timestamp_micros(start + minutes).cast("timestamp_ntz").alias("event_ts"),
        F.concat("text", suffix).alias("body"),
        F.when(conv % 10 < 7, "normal").when(conv % 10 < 9, "drift").otherwise("noise").alias("cohort"),
    )


FRAMES = """
fr as materialized (
  select conv_id, turn, 'conv-' || cast(conv_id as varchar) as stream_id,
         'req-' || cast(conv_id as varchar) || '-' || cast(turn as varchar) as request_id,
         'sess-' || cast(conv_id as varchar) as session_id,
         case conv_id % 3 when 0 then '/llm' when 1 then '/chat' else '/tools' end as route,
         case role when 'user' then 'request_body' when 'assistant' then 'response_body'
                   else 'request_headers' end as frame_type,
         turn + 1 as frame_seq,
         make_timestamp(1704067200000000 + (conv_id * 60 + turn) * 60000000) as event_ts,
         text || case when role = 'user' and conv_id % 10 = 0 then ' MALICIOUS-req-body'
                      when role = 'assistant' and conv_id % 7 = 0 then ' bypass-server' else '' end as body,
         case when conv_id % 10 < 7 then 'normal' when conv_id % 10 < 9 then 'drift' else 'noise' end as cohort
  from conversations
)"""


def headed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as really captured: only a leading header frame knows route, session and request id."""
    body = frames(spark, sf_dir).select(
        "stream_id", "frame_seq", "frame_type",
        F.lit(None).cast("string").alias("route"), F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("request_id"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        "event_ts",
    )
    conv = F.col("conv_id")
    head = frames(spark, sf_dir).groupBy("conv_id", "stream_id", "session_id", "route").agg(
        F.min("event_ts").alias("event_ts")
    )
    # Every fourth stream lacks a request id and falls back to its stream id.
    names = F.create_map(
        F.lit(":path"), F.col("route"), F.lit("X-Session-Id"), F.col("session_id"),
        F.lit("x-request-id"), F.when(conv % 4 != 0, text("r-", "conv_id")).otherwise(""),
    )
    head = head.select(
        "stream_id", F.lit(0).cast("bigint").alias("frame_seq"), F.lit("request_headers").alias("frame_type"),
        F.lit(None).cast("string").alias("route"), F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("request_id"), names.alias("headers"), "event_ts",
    )
    return body.unionByName(head)


# ---- envelopes ------------------------------------------------------------


def capture_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as JSON messages, with one irregularity per group of conversations."""
    f = frames(spark, sf_dir)
    kind, none = F.col("conv_id") % 11, F.lit(None)
    bare = F.col("conv_id") % 22 == 11  # no frame type and no body either
    names = (
        F.when(kind == 1, F.create_map(F.lit(":PATH"), F.col("route")))
        .when(kind == 2, F.create_map(F.lit("X-Envoy-Original-Path"), F.col("route")))
        .when(kind == 7, F.create_map(F.lit("X-Session-Id"), F.col("session_id")))
        .when(kind == 0, F.create_map(F.lit(":path"), F.col("route"), F.lit("x-session-id"), F.col("session_id")))
        .otherwise(F.create_map(F.lit("content-type"), F.lit("application/json")))
    )
    envelope = F.struct(
        F.concat_ws("-", F.lit("ev"), "conv_id", "turn").alias("event_id"),
        F.lit("capture").alias("source"),
        F.concat(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp"),
        "stream_id", "request_id",
        F.when(kind.isin(0, 1), none).when(kind == 2, "").otherwise(F.col("route")).alias("route"),
        F.when(kind.isin(0, 7), none).otherwise(F.col("session_id")).alias("session_id"),
        F.when(~bare, F.col("frame_type")).alias("frame_type"), "frame_seq",
        F.when(kind == 10, none).otherwise(names).alias("headers"),
        F.when(~bare, F.col("body")).alias("body"),
        F.when(kind == 4, none).otherwise(F.octet_length("body")).alias("body_size"),
        F.when(kind.isin(7, 9), none).otherwise("Safe").alias("decision"),
        F.when(kind == 3, F.concat(F.lit("override "), F.col("turn"))).alias("prompt"),
        "cohort",
    )
    json = F.to_json(envelope)
    extra = F.when(kind == 7, ',"decision":null}').when(kind == 8, ',"blocked":1,"warned":"","end_of_stream":"no"}')
    extra = extra.when(kind == 10, ',"headers":"x"}')
    # Values that are there but count as missing.
    false = ',"route":false,"session_id":0,"prompt":{},"completion":[]'
    extra = extra.when(bare, false + ',"frame_type":0,"body":false}').when(kind == 0, false + "}")
    # Cutting the closing brace makes the text malformed.
    value = F.when(kind == 6, json.substr(F.lit(1), F.length(json) - 1)).otherwise(
        F.coalesce(F.concat(json.substr(F.lit(1), F.length(json) - 1), extra), json)
    )
    messages = f.select(
        F.lit("capture").alias("kafka_topic"),
        (F.col("conv_id") % 3).cast("int").alias("kafka_partition"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("kafka_offset"),
        F.col("event_ts").cast("timestamp").alias("kafka_ts"),
        value.alias("value"),
        "conv_id",
    )
    again = messages.where(F.col("conv_id") % 11 == 5)
    return messages.unionByName(again).drop("conv_id")


# What the parser must make of the messages above, before duplicates are dropped.
PARSED = FRAMES + """,
dup as (select * from fr union all select * from fr where conv_id % 11 = 5),
pe as (
  select 'capture' as kafka_topic, cast(conv_id % 3 as integer) as kafka_partition,
         conv_id * 100 + turn as kafka_offset, event_ts as kafka_ts, request_id, route, session_id,
         case when conv_id % 22 = 11 then 'unknown' else frame_type end as frame_type,
         conv_id % 11 = 8 as end_of_stream,
         case conv_id % 11 when 1 then ':PATH: ' || route when 2 then 'X-Envoy-Original-Path: ' || route
              when 7 then 'X-Session-Id: ' || session_id
              when 0 then ':path: ' || route || chr(10) || 'x-session-id: ' || session_id else 'content-type: application/json' end as headers,
         case when conv_id % 22 = 11 then '' else body end as body, cast(strlen(body) as integer) as body_size,
         case conv_id % 11 when 7 then null when 9 then 'Unknown' else 'Safe' end as decision,
         conv_id % 11 = 8 as blocked, false as warned,
         case when conv_id % 11 = 3 then 'override ' || cast(turn as varchar)
              when frame_type = 'request_body' and conv_id % 22 <> 11 then body end as prompt_text,
         case when frame_type = 'response_body' and conv_id % 22 <> 11 then body end as completion_text,
         cohort, 'ev-' || cast(conv_id as varchar) || '-' || cast(turn as varchar) as event_id,
         stream_id, frame_seq, event_ts, conv_id, turn
  from dup where conv_id % 11 not in (6, 10)
)"""


# ---- remembered drift -----------------------------------------------------


def memory_of(turns: DataFrame, windows: DataFrame) -> DataFrame:
    """Drift turns of the settled past, as memory rows."""
    past = turns.join(windows, "route").where((F.col("cohort") == "drift") & (F.col("event_ts") <= F.col("window_end")))
    return past.select(
        F.col("request_id").alias("source_request_id"),
        F.col("session_id").alias("source_session_id"),
        F.col("route").alias("source_route"),
        "prompt_text",
        F.col("prompt_embedding").alias("embedding"),
        F.lit(0.0).alias("distance"),
        F.col("event_ts").cast("timestamp").alias("added_at"),
    )


