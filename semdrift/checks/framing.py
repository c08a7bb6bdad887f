"""Checks of frame operators: correlation, verdicts, decoding, streamed answers, context."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from semdrift.checks import views as W
from semdrift.checks.registry import query
from semdrift.functions import scalars as S
from semdrift.operators import filters, ordering
from semdrift.operators import frames as FR
from semdrift.scale import cut


@query(
    "correlated_frames",
    "J-05 X-07",
    f"""with {W.FRAMES} select stream_id, frame_seq, route, session_id,
case when conv_id % 4 <> 0 then 'r-' || cast(conv_id as varchar) else stream_id end as request_id
from (select conv_id, stream_id, frame_seq, route, session_id from fr
      union all select distinct conv_id, stream_id, 0, route, session_id from fr)""",
)
def correlated_frames(spark: SparkSession, d: str) -> DataFrame:
    known = FR.promote_headers(W.headed_frames(spark, d))
    return FR.correlate_frames(known).select("stream_id", "frame_seq", "route", "session_id", "request_id")


@query(
    "request_id_fallback",
    "X-07",
    f"with {W.FRAMES} select stream_id, turn, case when turn % 2 = 0 then request_id else stream_id end as request_id from fr",
)
def request_id_fallback(spark: SparkSession, d: str) -> DataFrame:
    known = F.when(F.col("turn") % 2 == 0, F.col("request_id")).otherwise("")
    return W.frames(spark, d).select(
        "stream_id", "turn", S.resolve_request_id(known, F.col("stream_id")).alias("request_id")
    )


VERDICT = """case frame_type when 'request_headers' then '-req-head' when 'request_body' then '-req-body'
 when 'response_body' then '-server' end"""


@query(
    "inspection_verdicts",
    "X-05 F-09",
    f"""with {W.FRAMES}, p as (select *, 'malicious' || {VERDICT} as b, 'bypass' || {VERDICT} as w from fr),
v as (select *, contains(lower(body), b) as block, contains(lower(body), w) as warn from p)
select request_id, case when block then 'Block' when warn then 'Warn' else 'Safe' end as decision, block as blocked,
       not block and warn as warned,
       case when block then 'keyword ''' || b || ''' detected' when warn then 'keyword ''' || w || ''' detected' end as rule_message
from v""",
)
def inspection_verdicts(spark: SparkSession, d: str) -> DataFrame:
    frames = W.frames(spark, d).withColumn("content", F.col("body"))
    out = FR.inspect(frames, FR.keyword_rules(spark))
    return out.select("request_id", "decision", "blocked", "warned", "rule_message")


@query(
    "many_rules",
    "X-05 F-09",
    f"""with {W.FRAMES}, ru as (
  select distinct frame_type, lower(substring(body, 3, 4)) as pattern, case when conv_id % 3 = 0 then 0 else 1 end as rank from fr),
hits as (
  select f.request_id, arg_min(r.pattern, {{'k': r.rank, 'p': r.pattern}}) as pattern, min(r.rank) as rank
  from fr f join ru r on r.frame_type = f.frame_type and contains(lower(f.body), r.pattern) group by f.request_id)
select f.request_id, case h.rank when 0 then 'Block' when 1 then 'Warn' else 'Safe' end as decision,
       'keyword ''' || h.pattern || ''' detected' as rule_message
from fr f left join hits h on h.request_id = f.request_id""",
)
def many_rules(spark: SparkSession, d: str) -> DataFrame:
    """Hundreds of rules, taken from the frames themselves."""
    frames = W.frames(spark, d)
    action = F.when(F.col("conv_id") % 3 == 0, "Block").otherwise("Warn").alias("action")
    rules = frames.select("frame_type", F.substring("body", 3, 4).alias("pattern"), action).distinct()
    out = FR.inspect(frames.withColumnRenamed("body", "content"), rules)
    return out.select("request_id", "decision", "rule_message")


@query(
    "rule_matches",
    "F-09",
    f"with {W.FRAMES} select request_id from fr where contains(lower(body), 'malicious')",
)
def rule_matches(spark: SparkSession, d: str) -> DataFrame:
    return W.frames(spark, d).where(FR.matches_rule(F.col("body"), "Malicious")).select("request_id")


@query(
    "sampled_streams",
    "F-08",
    f"with {W.FRAMES} select 'all' as sample, count(*) as n from fr union all select 'none', 0",
)
def sampled_streams(spark: SparkSession, d: str) -> DataFrame:
    frames = W.frames(spark, d)

    def size(name: str, rate: float) -> DataFrame:
        kept = filters.sample_streams(frames, rate)
        return kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sample"), "n")

    return size("all", 1.5).unionByName(size("none", -1.0))


@query("half_sampled_streams", "F-08")
def half_sampled_streams(spark: SparkSession, d: str) -> DataFrame:
    return filters.sample_streams(W.frames(spark, d), 0.5).select("stream_id", "frame_seq")


@query(
    "numbered_frames",
    "W-05",
    f"with {W.FRAMES} select stream_id, request_id, "
    "row_number() over (partition by stream_id order by event_ts, request_id) as frame_seq from fr",
)
def numbered_frames(spark: SparkSession, d: str) -> DataFrame:
    plain = W.frames(spark, d).select(
        "stream_id", "request_id", F.col("event_ts").alias("timestamp"), F.col("request_id").alias("event_id")
    )
    return ordering.frame_seq(plain).select("stream_id", "request_id", "frame_seq")


@F.pandas_udf(BinaryType())
def zipped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: gzip.compress(t.encode("utf-8"), mtime=0))


@query(
    "decoded_bodies",
    "D-02",
    f"with {W.FRAMES} select request_id as stream_id, strlen(body) as n_bytes, md5(body) as digest from fr",
)
def decoded_bodies(spark: SparkSession, d: str) -> DataFrame:
    # Every body becomes one response in three chunks; answers are zipped.
    bodies = W.frames(spark, d).withColumn("zip", F.col("frame_type") == "response_body")
    bodies = bodies.withColumn("data", F.when(F.col("zip"), zipped("body")).otherwise(F.encode("body", "UTF-8")))
    third = F.ceil(F.octet_length("data") / 3).cast("int")
    chunks = bodies.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
        F.col("request_id").alias("stream_id"),
        F.col("i").cast("bigint").alias("frame_seq"),
        F.when(F.col("zip"), " GZip ").otherwise("identity").alias("encoding"),
        F.substring("data", F.col("i") * third + 1, third).alias("body"),
        (F.col("i") == 2).alias("end_of_stream"),
    )
    plain = FR.decode_bodies(chunks)
    text = F.expr("listagg(hex(body), '') within group (order by frame_seq)")
    whole = plain.groupBy("stream_id").agg(F.unhex(text).alias("body"))
    return whole.select("stream_id", F.octet_length("body").alias("n_bytes"), F.md5("body").alias("digest"))


def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    """Answers as server-sent events, one per word, cut into chunks of 400 characters."""
    answers = W.frames(spark, d).where(F.col("frame_type") == "response_body")
    words = F.split("body", " ")

    def event(word, i):
        # Every fifth word is reasoning; the others are content.
        delta = F.when(i % 5 == 4, F.to_json(F.struct(F.concat(word, F.lit(" ")).alias("reasoning")))).otherwise(
            F.to_json(F.struct(F.concat(word, F.lit(" ")).alias("content")))
        )
        return F.concat(F.lit('data: {"choices":[{"delta":'), delta, F.lit("}]}\n: ping\n\n"))

    noise = F.lit('data: {broken\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"lost"}}]}')
    text = F.concat(F.array_join(F.transform(words, event), ""), noise)
    sent = answers.select(F.col("request_id").alias("stream_id"), text.alias("text"))
    last = F.ceil(F.length("text") / 400).cast("int") - 1
    cuts = sent.select("stream_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return cuts.select(
        "stream_id", F.col("i").cast("bigint").alias("frame_seq"),
        F.substring("text", F.col("i") * 400 + 1, F.lit(400)).alias("body"),
    )


@query(
    "streamed_answers",
    "D-03",
    f"""with {W.FRAMES}, w as (select request_id, string_split(body, ' ') as words from fr where frame_type = 'response_body')
select request_id as stream_id,
  array_to_string([x || ' ' for x, i in words if i % 5 <> 0], '') as content,
  array_to_string([x || ' ' for x, i in words if i % 5 = 0], '') as reasoning from w""",
)
def streamed_answers(spark: SparkSession, d: str) -> DataFrame:
    return FR.assemble_sse(cut(sse_frames(spark, d)))


@query(
    "unstreamed_answers",
    "D-03",
    f"with {W.FRAMES} select request_id as stream_id, body as content, 'because ' || turn as reasoning "
    "from fr where frame_type = 'response_body'",
)
def unstreamed_answers(spark: SparkSession, d: str) -> DataFrame:
    answers = W.frames(spark, d).where(F.col("frame_type") == "response_body")
    message = F.struct(F.col("body").alias("content"), F.concat(F.lit("because "), "turn").alias("reasoning_content"))
    document = F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices")))
    return FR.assemble_json(answers.select(F.col("request_id").alias("stream_id"), document.alias("body")))


CONTEXT = """ctx as (
  select conv_id, turn, role, text,
         (select min_by(trim(s.text), s.turn) from conversations s where s.conv_id = c.conv_id and s.role = 'system') as sys
  from conversations c
),
told as (select * from ctx where role = 'user' or (role = 'assistant' and text <> ''))"""


@query(
    "context_spans",
    "D-04",
    f"""with {CONTEXT}, sums as (
  select conv_id, turn, role, sys, count(*) over w as n, sum(strlen(text)) over w as b from told
  window w as (partition by conv_id order by turn rows unbounded preceding))
select conv_id, turn, n + case when sys <> '' then 1 else 0 end as n_messages,
       cast(b + coalesce(strlen(sys), 0) as bigint) as n_bytes from sums where role = 'user'""",
)
def context_spans(spark: SparkSession, d: str) -> DataFrame:
    return FR.context_spans(W.table(spark, d, "conversations"))


@query(
    "prompt_context",
    "D-04",
    f"""with {CONTEXT}, lines as (
  select conv_id, turn, role, sys, string_agg(role || ':' || text, chr(10)) over
    (partition by conv_id order by turn rows unbounded preceding) as t from told)
select conv_id, turn, md5(case when sys <> '' then 'system:' || sys || chr(10) else '' end || t) as digest
from lines where role = 'user'""",
)
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    contexts = FR.build_context(W.table(spark, d, "conversations"))
    lines = F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.content))
    return contexts.select("conv_id", "turn", F.md5(F.array_join(lines, "\n")).alias("digest"))


@query(
    "named_prompt_context",
    "D-04",
    f"""with {CONTEXT}, lines as (
  select conv_id, turn, role, sys, string_agg(role || ':' || text, chr(10)) over
    (partition by conv_id order by turn rows unbounded preceding) as t from told)
select conv_id, turn, md5(case when sys <> '' then 'system:' || sys || chr(10) else '' end || t) as digest
from lines where role = 'user' qualify row_number() over (partition by conv_id order by turn desc) = 1""",
)
def named_prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of the last user turns only."""
    turns = W.table(spark, d, "conversations")
    last = turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    lines = F.transform("messages", lambda m: F.concat(m.role, F.lit(":"), m.content))
    return FR.build_context(turns, last).select("conv_id", "turn", F.md5(F.array_join(lines, "\n")).alias("digest"))
