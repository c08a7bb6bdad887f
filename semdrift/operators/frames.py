"""Captured frames: correlation, keyword verdicts, body decoding, streamed answers, context."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semdrift.functions import scalars as S
from semdrift.operators.ordering import GROUP_ROWS, running_total
from semdrift.scale import small_side

# Suffix that a rule keyword carries per frame type.
RULE_SUFFIXES = {
    "request_headers": "-req-head",
    "request_body": "-req-body",
    "response_headers": "-res-head",
    "response_body": "-server",
}
# Default rule keywords.
BLOCK_KEYWORD = "malicious"
WARN_KEYWORD = "bypass"


# More rules than this are matched by an automaton, if their patterns have at most so many bytes.
MANY_RULES, RULE_BYTES = 64, 4 * 1024 * 1024


# ---- correlation ----------------------------------------------------------


def correlate_frames(frames: DataFrame) -> DataFrame:
    """Give every frame its stream's route, session and request id.

    Frames that carry a value keep it; others take the first one found in the
    stream by frame order, and the request id falls back to the stream id.
    """

    def first(name: str) -> Column:
        return F.min_by(name, F.when(S.present(F.col(name)).isNotNull(), F.struct("frame_seq", name))).alias(f"_{name}")

    known = frames.groupBy("stream_id").agg(first("route"), first("session_id"), first("request_id"))
    filled = frames.join(known, "stream_id", "left")
    return filled.select(
        *[c for c in frames.columns if c not in ("route", "session_id", "request_id")],
        S.first_present(F.col("route"), F.col("_route")).alias("route"),
        S.first_present(F.col("session_id"), F.col("_session_id")).alias("session_id"),
        F.coalesce(
            S.present(F.col("request_id")), S.resolve_request_id(F.col("_request_id"), F.col("stream_id"))
        ).alias("request_id"),
    )


def promote_headers(frames: DataFrame) -> DataFrame:
    """Fill empty route, session and request id from the frame's own headers."""
    h = F.col("headers")
    return frames.withColumns(
        {
            "route": S.resolve_route(F.col("route"), h),
            "session_id": S.resolve_session(F.col("session_id"), h),
            "request_id": S.first_present(F.col("request_id"), S.header_value(h, S.REQUEST_HEADER)),
        }
    )


# ---- inspection -----------------------------------------------------------


def matches_rule(content: Column, pattern: Column | str) -> Column:
    """Case-insensitive substring test."""
    pattern = F.lit(pattern.lower()) if isinstance(pattern, str) else F.lower(pattern)
    return F.coalesce(F.contains(F.lower(content), pattern), F.lit(False))


def keyword_rules(spark: SparkSession, block: str = BLOCK_KEYWORD, warn: str = WARN_KEYWORD) -> DataFrame:
    """The two-keyword rule set: one block and one warn pattern per frame type."""
    rows = [
        {"frame_type": frame, "pattern": f"{word.lower()}{suffix}", "action": action}
        for frame, suffix in RULE_SUFFIXES.items()
        for word, action in ((block, "Block"), (warn, "Warn"))
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def inspect(frames: DataFrame, rules: DataFrame, many: int = MANY_RULES) -> DataFrame:
    """Verdict per frame: decision, blocked, warned and the rule that fired.

    Blocking rules come first, then patterns in their order. Up to ``many`` rules become one array per frame type, and
    a frame meets only its own rules. More of them, while their patterns stay below ``RULE_BYTES``, become one
    multi-pattern automaton per frame type, and a text is read once whatever their number. Both give the same rows.
    Rules without a pattern or a frame type never fire; an empty pattern always does.
    """
    rank = F.when(F.col("action") == "Block", 0).otherwise(1)
    named = rules.where("pattern is not null and frame_type is not null").select("frame_type", F.lower("pattern").alias("pattern"), rank.alias("rank"), "action")
    tested = frames.withColumn("_text", F.lower(F.coalesce("content", F.lit(""))))
    count, size = named.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    if count > many and size <= RULE_BYTES:
        tested = tested.withColumn("_hit", _first_rule(named)("frame_type", "_text"))
    else:
        listed = named.groupBy("frame_type").agg(F.array_sort(F.collect_list(F.struct("rank", "pattern", "action"))).alias("_rules"))
        # At most one row per frame type, but with all of its rules.
        tested = tested.join(small_side(listed), "frame_type", "left")
        tested = tested.withColumn("_hit", F.get(F.filter("_rules", lambda r: F.contains(F.col("_text"), r.pattern)), F.lit(0))).drop("_rules")
    tested = tested.select(*[F.col(f"`{c}`") for c in frames.columns], "_hit")
    return tested.withColumns(
        {
            "decision": F.coalesce("_hit.action", F.lit("Safe")),
            "blocked": F.coalesce(F.col("_hit.action") == "Block", F.lit(False)),
            "warned": F.coalesce(F.col("_hit.action") == "Warn", F.lit(False)),
            "rule_message": F.concat(F.lit("keyword '"), F.col("_hit.pattern"), F.lit("' detected")),
        }
    ).drop("_hit")


def _first_rule(rules: DataFrame):
    """The rule of a frame type that stands first among those whose pattern a text holds. ``rules``: size-checked."""
    rows = sorted((tuple(r) for r in rules.distinct().collect()), key=lambda r: (r[0], r[2], r[1], r[3] is None, r[3] or ""))
    book, name = rules.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    @F.arrow_udf("rank int, pattern string, action string")
    def first(kinds: pa.Array, texts: pa.Array) -> pa.Array:
        rules, machines, found = book.value, _machines(name, book), []
        for kind, text in zip(kinds.to_pylist(), texts.to_pylist(), strict=True):
            machine, best = machines.get(kind, (None, None))
            for _, place in machine.iter(text) if machine is not None else ():
                best = place if best is None else min(best, place)
            found.append(None if best is None else {"rank": rules[best][2], "pattern": rules[best][1], "action": rules[best][3]})
        return pa.array(found, pa.struct([("rank", pa.int32()), ("pattern", pa.string()), ("action", pa.string())]))

    return first


_MACHINES: dict[str, dict] = {}


def _machines(name: str, book) -> dict:
    """Per frame type the automaton of its patterns and the place of an empty one, built once per worker process."""
    if name not in _MACHINES:
        import ahocorasick

        built: dict[str, list] = {}
        for place, (kind, pattern, _, _) in enumerate(book.value):
            held = built.setdefault(kind, [ahocorasick.Automaton(), None])
            if not pattern:
                held[1] = place if held[1] is None else held[1]
            elif pattern not in held[0]:  # rows are in order, so the first of equal patterns stands
                held[0].add_word(pattern, place)
        for held in built.values():
            if len(held[0]):
                held[0].make_automaton()
            else:
                held[0] = None
        _MACHINES.clear()
        _MACHINES[name] = {kind: tuple(held) for kind, held in built.items()}
    return _MACHINES[name]


# ---- compressed bodies ----------------------------------------------------

DECODED_SCHEMA = "stream_id string, frame_seq bigint, body binary"


def decode_bodies(frames: DataFrame) -> DataFrame:
    """Unzip gzip response bodies that arrive in chunks; other bodies pass through.

    ``frames``: stream_id, frame_seq, encoding, body (binary), end_of_stream.
    Only gzip frames are shuffled. Each stream is unzipped chunk by chunk in
    frame order with one decoder, so a task holds one chunk at a time.
    A chunk that cannot be unzipped keeps its raw bytes.
    """
    zipped = F.coalesce(F.lower(S.strip(F.col("encoding"))), F.lit("")) == "gzip"
    plain = frames.where(~zipped).select("stream_id", "frame_seq", "body")
    ordered = (
        frames.where(zipped)
        .select("stream_id", "frame_seq", "end_of_stream", "body")
        .repartition("stream_id")
        .sortWithinPartitions("stream_id", "frame_seq")
    )
    return plain.unionByName(ordered.mapInArrow(_unzip, DECODED_SCHEMA))


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream, decoder = object(), None
    for batch in batches:
        bodies = []
        rows = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True)
        for stream_id, last, chunk in rows:
            if stream_id != stream:
                stream, decoder = stream_id, zlib.decompressobj(zlib.MAX_WBITS | 16)
            text, decoder = _unzip_chunk(decoder, chunk or b"", last)
            bodies.append(chunk if text is None else text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(bodies, pa.binary())], names=["stream_id", "frame_seq", "body"]
        )


def _unzip_chunk(decoder, chunk: bytes, last: bool):
    """(plain bytes or None on error, decoder to go on with or None after an error)."""
    if decoder is None:
        return None, None
    out = b""
    try:
        while True:
            out += decoder.decompress(chunk)
            if not decoder.eof or not decoder.unused_data:
                break
            chunk, decoder = decoder.unused_data, zlib.decompressobj(zlib.MAX_WBITS | 16)
    except zlib.error:
        return None, None
    if last and not decoder.eof:
        return None, None
    return out, decoder


# ---- streamed answers -----------------------------------------------------


def stream_lines(frames: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Lines of each stream: (stream_id, line_no, line, complete), chunks joined in frame order.

    A line may span chunks, so each piece gets the number of line breaks
    before it; only the pieces of one line are ever put together. A line is
    complete once a piece of it ends in a break.
    """
    return _join_pieces(frames.select("stream_id", "frame_seq", _pieces().alias("pieces")), group_rows)


def _pieces() -> Column:
    return F.split(F.coalesce("body", F.lit("")), "\n")


def _join_pieces(chunks: DataFrame, group_rows: int) -> DataFrame:
    """Lines from chunks (stream_id, frame_seq, pieces, ...). What else a chunk has goes to the line that its first break ends."""
    more = [c for c in chunks.columns if c not in ("stream_id", "frame_seq", "pieces")]
    breaks = (F.size("pieces") - 1).cast("bigint")
    placed = running_total(chunks, ["stream_id"], [F.col("frame_seq")], breaks, "_upto", group_rows)
    exploded = placed.select(
        "stream_id", "frame_seq", (F.col("_upto") - breaks).alias("_before"), breaks.alias("_breaks"), *more,
        F.posexplode("pieces").alias("_at", "piece"),
    )
    ends = (F.col("_at") == 0) & (F.col("_breaks") > 0)
    lines = exploded.groupBy("stream_id", (F.col("_before") + F.col("_at")).alias("line_no")).agg(
        F.expr("listagg(piece, '') within group (order by frame_seq)").alias("line"),
        F.bool_or(F.col("_at") < F.col("_breaks")).alias("complete"),
        *[F.max(F.when(ends, F.col(c))).alias(c) for c in more],
    )
    return lines.withColumn("line", S.strip(F.col("line")))


def _document(line: Column) -> Column:
    """The parsed document of a server-sent ``data:`` line; NULL for other lines."""
    data = F.substring(line, 7, 2**31 - 1)
    return F.try_parse_json(F.when(F.startswith(line, F.lit("data: ")) & (data != "[DONE]"), data))


def _delta(v: Column) -> tuple[Column, Column]:
    def field(name: str) -> Column:
        return S.present(F.try_variant_get(v, f"$.choices[0].delta.{name}", "string"))

    return field("content").alias("content"), F.coalesce(field("reasoning_content"), field("reasoning")).alias("reasoning")


def sse_deltas(lines: DataFrame) -> DataFrame:
    """Add the content and reasoning piece of each server-sent ``data:`` line; NULL for other lines."""
    kept = [c for c in lines.columns if c not in ("line", "complete")]
    # The generator keeps the document from being parsed once per field.
    document = F.when(F.col("complete"), _document(F.col("line")))
    return lines.select(*kept, F.explode(F.array(document)).alias("v")).select(*kept, *_delta(F.col("v")))


def assemble_sse(frames: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The answer and reasoning text of each streamed response.

    What follows the last line break is incomplete and dropped. Lines that
    lie whole within a chunk are read where the chunk is; only their text,
    not the event lines around it, and the chunk's first and last piece are
    shuffled and put together per stream.
    """
    inner = F.transform(F.slice("pieces", 2, F.greatest(F.size("pieces") - 2, F.lit(0))), lambda line: _document(S.strip(line)))
    edges = F.when(F.size("pieces") > 2, F.array(F.get("pieces", F.lit(0)), F.element_at("pieces", -1))).otherwise(F.col("pieces"))
    chunks = frames.select("stream_id", "frame_seq", _pieces().alias("pieces"))
    chunks = chunks.select("stream_id", "frame_seq", edges.alias("pieces"), F.transform(inner, lambda v: F.struct(*_delta(v))).alias("_inner"))
    inside = [F.array_join(f"_inner.{c}", "").alias(f"_{c}") for c in ("content", "reasoning")]
    deltas = sse_deltas(_join_pieces(chunks.select("stream_id", "frame_seq", "pieces", *inside), group_rows))
    # The lines inside a chunk follow the line that its first break ends.
    texts = [F.concat(F.coalesce(c, F.lit("")), F.coalesce(f"_{c}", F.lit(""))).alias(c) for c in ("content", "reasoning")]
    return deltas.select("stream_id", "line_no", *texts).groupBy("stream_id").agg(
        *[
            F.coalesce(F.expr(f"listagg({c}, '') within group (order by line_no)"), F.lit("")).alias(c)
            for c in ("content", "reasoning")
        ]
    )


def assemble_json(bodies: DataFrame) -> DataFrame:
    """The same from unstreamed responses: one JSON document per stream."""
    v = bodies.withColumn("v", F.try_parse_json("body")).where(F.col("v").isNotNull())

    def field(name: str) -> Column:
        return S.present(F.try_variant_get("v", f"$.choices[0].message.{name}", "string"))

    return v.select(
        "stream_id",
        F.coalesce(field("content"), F.lit("")).alias("content"),
        F.coalesce(field("reasoning_content"), field("reasoning"), F.lit("")).alias("reasoning"),
    )


# ---- conversation context -------------------------------------------------


def _told() -> Column:
    """Messages that stay in a conversation's history: user turns and non-empty answers."""
    return F.coalesce(
        (F.col("role") == "user") | ((F.col("role") == "assistant") & S.has_text(F.col("text"))), F.lit(False)
    )


def _first_system() -> Column:
    return F.min(F.when(F.col("role") == "system", F.struct("turn", F.trim("text").alias("text"))))


def context_spans(turns: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Number and size of the messages sent with each user turn.

    The context of a turn is a prefix of its conversation's history, so one
    running count and one running size describe all contexts without copying
    any text.
    """
    order = [F.col("turn")]
    told = turns.where(_told()).select("conv_id", "turn", "role", F.octet_length("text").cast("bigint").alias("_bytes"))
    counted = running_total(told, ["conv_id"], order, F.lit(1).cast("bigint"), "_messages", group_rows)
    sized = running_total(counted, ["conv_id"], order, F.col("_bytes"), "_size", group_rows)
    system = turns.where(F.col("role") == "system").groupBy("conv_id").agg(_first_system().alias("s"))
    system = system.where(S.has_text(F.col("s.text"))).select("conv_id", F.octet_length("s.text").alias("_system"))
    return (
        sized.where(F.col("role") == "user")
        .join(system, "conv_id", "left")
        .select(
            "conv_id",
            "turn",
            (F.col("_messages") + F.when(F.col("_system").isNotNull(), 1).otherwise(0)).alias("n_messages"),
            (F.col("_size") + F.coalesce("_system", F.lit(0))).alias("n_bytes"),
        )
    )


def build_context(turns: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Messages sent with each user turn: system prompt, earlier turns, the new message.

    ``turns``: conv_id, turn, role, text. The result repeats a conversation's
    history for each of its user turns; ``context_spans`` describes the same
    prefixes without the copies. ``named`` (conv_id, turn) asks for some turns
    only: each then meets its own history, once, and no other is built.
    """
    if named is not None:
        return _named_context(turns, named)
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    history = F.collect_list(F.when(_told(), F.struct("role", F.col("text").alias("content")))).over(order)
    system = _first_system().over(Window.partitionBy("conv_id"))
    message = F.struct(F.lit("system").alias("role"), system.text.alias("content"))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    head = F.when(S.has_text(system.text), F.array(message)).otherwise(empty)
    with_history = turns.withColumn("messages", F.concat(head, history))
    return with_history.where(F.col("role") == "user").select("conv_id", "turn", "messages")


def _named_context(turns: DataFrame, named: DataFrame) -> DataFrame:
    """One aggregate per named turn over the messages up to it."""
    wanted = named.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_at")).distinct()
    asked = turns.where(F.col("role") == "user").select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_at"))
    wanted = asked.join(wanted, ["_conv", "_at"], "left_semi").distinct()
    earlier = turns.join(wanted, (F.col("conv_id") == F.col("_conv")))
    told = F.when(_told() & (F.col("turn") <= F.col("_at")), F.struct("turn", "role", F.col("text").alias("content")))
    built = earlier.groupBy(F.col("_conv").alias("conv_id"), F.col("_at").alias("turn")).agg(
        F.array_sort(F.collect_list(told)).alias("told"), _first_system().alias("system")
    )
    message = F.struct(F.lit("system").alias("role"), F.col("system.text").alias("content"))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    head = F.when(S.has_text(F.col("system.text")), F.array(message)).otherwise(empty)
    body = F.transform("told", lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    return built.select("conv_id", "turn", F.concat(head, body).alias("messages"))
