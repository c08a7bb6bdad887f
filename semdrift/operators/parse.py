"""Envelope JSON to typed event columns, with rejects set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.functions import scalars as S

# Columns of the stored event.
EVENT_COLUMNS = [
    "kafka_topic", "kafka_partition", "kafka_offset", "kafka_ts", "request_id", "route", "session_id",
    "frame_type", "end_of_stream", "headers", "body", "body_size", "decision", "blocked", "warned",
    "event_json", "prompt_text", "completion_text", "prompt_embedding", "completion_embedding", "cohort",
]
# Kept besides the event columns because frames and windows need them typed.
EXTRA_COLUMNS = ["event_id", "source", "stream_id", "frame_seq", "event_ts"]


# Fields read as text, and fields whose JSON type matters too.
_TEXTS = (
    "request_id", "route", "session_id", "frame_type", "body", "body_size", "decision", "prompt", "completion",
    "cohort", "event_id", "source", "stream_id", "frame_seq", "timestamp", "end_of_stream", "blocked", "warned", "headers",
)
_KINDS = (
    "body_size", "decision", "end_of_stream", "blocked", "warned", "headers",
    "route", "session_id", "frame_type", "body", "prompt", "completion",
)


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    Plain projections are merged into the expressions that use them, which
    would parse a document once per field. A generator is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def _text(name: str) -> Column:
    return F.col(f"_{name}")


def _kind(name: str) -> Column:
    return F.col(f"_kind_{name}")


def _truthy(name: str) -> Column:
    """Whether the JSON value counts as true: not null, false, zero or empty."""
    kind, text = _kind(name), _text(name)
    return (
        F.when(kind.isNull() | (kind == "VOID"), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), ~text.isin("{}", "[]"))
        .otherwise(text.try_cast("double") != 0)
    )


def _given(name: str) -> Column:
    """The field's text, or NULL when its JSON value counts as false."""
    return F.when(_truthy(name), _text(name))


def _reject_reason() -> Column:
    size = _text("body_size").try_cast("double")
    whole = size.try_cast("int").isNotNull() & (F.abs(size) < 2**31)
    bad_size = _kind("body_size").isNotNull() & ~F.coalesce(whole, F.lit(False))
    return (
        F.when(F.col("envelope").isNull(), "malformed json")
        .when(~F.col("_kind").startswith("OBJECT"), "not an object")
        .when(_truthy("headers") & ~_kind("headers").startswith("OBJECT"), "headers not an object")
        .when(bad_size, "bad body_size")
    )


def _fields(messages: DataFrame) -> DataFrame:
    """Messages with every envelope field and the reject reason as columns."""

    def get(name: str, kind: str) -> Column:
        return F.try_variant_get("envelope", f"$.{name}", kind)

    parsed = _once(messages, F.try_parse_json("value").alias("envelope"))
    fields = _once(
        parsed,
        F.schema_of_variant("envelope").alias("_kind"),
        *[get(n, "string").alias(f"_{n}") for n in _TEXTS],
        *[F.schema_of_variant(get(n, "variant")).alias(f"_kind_{n}") for n in _KINDS],
        F.coalesce(get("headers", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("headers"),
    )
    return _once(
        fields,
        _reject_reason().alias("reason"),
        F.coalesce(_given("body"), F.lit("")).alias("body"),
        F.coalesce(_given("frame_type"), F.lit("unknown")).alias("frame_type"),
    )


def parse_events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) from messages with Kafka columns and a JSON ``value``.

    A message is in exactly one of them.
    """
    fields = _fields(messages)
    rejects = fields.where(F.col("reason").isNotNull()).select(*messages.columns, "reason")
    return fields.where(F.col("reason").isNull()).select(*_typed(fields)), rejects


def parse_messages(messages: DataFrame) -> DataFrame:
    """Events and rejects in one table, to be kept and read with ``events_of`` and ``rejects_of``.

    Rejects have a ``reason``, and their message as ``rejected``.
    """
    fields = _fields(messages)
    bad = F.col("reason").isNotNull()
    return fields.select(*_typed(fields), "reason", F.when(bad, F.struct(*messages.columns)).alias("rejected"))


def events_of(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason", "rejected")


def rejects_of(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("rejected.*", "reason")


def _typed(fields: DataFrame) -> list[Column | str]:
    body, frame, headers = F.col("body"), F.col("frame_type"), F.col("headers")

    def of_stream(own: Column, name: str) -> Column:
        """The frame's own value, else that of its stream where messages carry one."""
        stream = f"stream_{name}"
        return S.first_present(own, F.col(stream)) if stream in fields.columns else own

    return [
        "kafka_topic", "kafka_partition", "kafka_offset", "kafka_ts",
        of_stream(_text("request_id"), "request_id").alias("request_id"),
        of_stream(S.resolve_route(_given("route"), headers), "route").alias("route"),
        of_stream(S.resolve_session(_given("session_id"), headers), "session_id").alias("session_id"),
        "frame_type",
        _truthy("end_of_stream").alias("end_of_stream"),
        "headers", "body",
        F.coalesce(_text("body_size").try_cast("double").try_cast("int"), S.byte_length(body)).alias("body_size"),
        # Only a missing decision gets the default; an explicit null stays null.
        F.when(_kind("decision").isNull(), "Unknown").otherwise(_text("decision")).alias("decision"),
        _truthy("blocked").alias("blocked"),
        _truthy("warned").alias("warned"),
        F.col("value").alias("event_json"),
        S.prompt_text(frame, body, _given("prompt")).alias("prompt_text"),
        S.completion_text(frame, body, _given("completion")).alias("completion_text"),
        F.lit(None).cast("array<float>").alias("prompt_embedding"),
        F.lit(None).cast("array<float>").alias("completion_embedding"),
        _text("cohort").alias("cohort"),
        _text("event_id").alias("event_id"),
        _text("source").alias("source"),
        _text("stream_id").alias("stream_id"),
        _text("frame_seq").try_cast("bigint").alias("frame_seq"),
        S.event_time(_text("timestamp")).alias("event_ts"),
    ]
