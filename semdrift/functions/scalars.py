"""Column expressions for text, headers, times and verdict labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace that trimming removes.
BLANKS = " \t\n\r\x0b\x0c"

# Headers that name the route and the session.
ROUTE_HEADERS = (":path", "x-envoy-original-path")
SESSION_HEADER = "x-session-id"
REQUEST_HEADER = "x-request-id"

# Task prefixes put before a text when it is embedded.
TASK_PREFIXES = {"query": "search_query: ", "document": "search_document: "}

# Payload kind to frame type.
FRAME_TYPES = {
    "RequestHeader": "request_headers",
    "RequestBody": "request_body",
    "ResponseHeader": "response_headers",
    "ResponseBody": "response_body",
}


def present(col: Column) -> Column:
    """The text, or NULL when it is empty."""
    return F.nullif(col, F.lit(""))


def first_present(*cols: Column) -> Column:
    """First text that is neither NULL nor empty."""
    return F.coalesce(*[present(c) for c in cols])


def has_text(col: Column) -> Column:
    """True for text worth embedding: blank text counts, empty text does not."""
    return F.coalesce(col != "", F.lit(False))


def header_value(headers: Column, key: str) -> Column:
    """Value of the first header whose name equals ``key`` ignoring case."""
    hits = F.map_filter(headers, lambda k, _: F.lower(k) == key.lower())
    return F.get(F.map_values(hits), F.lit(0))


def headers_text(headers: Column) -> Column:
    """Headers as sorted ``key: value`` lines, trimmed."""
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e.key, F.lit(": "), e.value))
    return strip(F.array_join(lines, "\n"))


def strip(col: Column) -> Column:
    """Text without blanks and line breaks at both ends."""
    return F.trim(col, F.lit(BLANKS))


def resolve_route(route: Column, headers: Column) -> Column:
    return first_present(route, *[header_value(headers, h) for h in ROUTE_HEADERS])


def resolve_session(session_id: Column, headers: Column) -> Column:
    return first_present(session_id, header_value(headers, SESSION_HEADER))


def resolve_request_id(request_id: Column, stream_id: Column) -> Column:
    return F.coalesce(present(request_id), stream_id)


def prompt_text(frame_type: Column, body: Column, prompt: Column) -> Column:
    return F.coalesce(present(prompt), F.when(frame_type == "request_body", body))


def completion_text(frame_type: Column, body: Column, completion: Column) -> Column:
    return F.coalesce(present(completion), F.when(frame_type == "response_body", body))


def byte_length(col: Column) -> Column:
    return F.octet_length(col)


def preview(col: Column, n: int) -> Column:
    return F.left(col, F.lit(n))


def event_time(text: Column) -> Column:
    """Timestamp from ISO-8601 text; NULL when it is not one."""
    return text.try_cast("timestamp")


def json_time(json_text: Column, path: str) -> Column:
    return event_time(F.get_json_object(json_text, path))


def window_end(start: Column, end: Column, fraction: float) -> Column:
    """``start + (end - start) * fraction``, to the microsecond."""
    a, b = F.unix_micros(start.cast("timestamp")), F.unix_micros(end.cast("timestamp"))
    return F.timestamp_micros((a + F.floor((b - a) * F.lit(float(fraction)))).cast("long"))


def frame_type(kind: Column) -> Column:
    out = F.lit("unknown")
    for name, value in FRAME_TYPES.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def flagged_by(statistical: Column, memory: Column) -> Column:
    return (
        F.when(statistical & memory, F.lit("both"))
        .when(statistical, F.lit("baseline"))
        .when(memory, F.lit("memory"))
    )


def prefixed(col: Column, kind: str) -> Column:
    return F.concat(F.lit(TASK_PREFIXES[kind]), col)
