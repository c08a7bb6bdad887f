"""Route, session and request id of a stream's header frame for all frames of the stream, across micro-batches.

State is kept for each stream id: the first values found (by frame number) and, until the header frame has come, the
frames that wait for it. A waiting frame goes on with what is known once the header frame comes, or ``wait_ms`` after
the stream's last frame, whichever is first; a stream that is silent for ``keep_ms`` is forgotten. The event time of
these timers is the time of the micro-batch in which a frame came, which is in the offset log and so the same when a
batch is run again. No frame is ever behind that watermark, so none is dropped as late. Timers fire with a later
micro-batch; a query that has stopped hands out what waits after it is started again.

A call of the state function costs far more than a frame, so the streams of one of ``BUCKETS`` hash values share a
call and a state. Each keeps a deadline of its own; the bucket's timer is the earliest of them.

Only frames that lack a value, and header frames, pass through the state. Frames without a stream id, frames that
know everything and malformed messages go by, so they never meet in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from semdrift.functions import scalars as S
from semdrift.operators.frames import promote_headers
from semdrift.operators.parse import parse_events

# Fixed value: the frame type that carries a stream's headers.
HEADER_FRAME = "request_headers"
MESSAGE = ["kafka_topic", "kafka_partition", "kafka_offset", "kafka_ts", "value"]
_NAMES = ["route", "session_id", "request_id"]
_OUT = "kafka_topic string, kafka_partition int, kafka_offset long, micros long, value string, stream_route string, stream_session_id string, stream_request_id string"
_STATE = "streams string"
# Calls of the state function per micro-batch, at most. A checkpoint goes on only with the number it began with.
BUCKETS = 512


def correlate_messages(messages: DataFrame, wait_ms: int = 60_000, keep_ms: int = 3_600_000) -> DataFrame:
    """Streaming messages with ``stream_route``, ``stream_session_id`` and ``stream_request_id`` of their stream.

    These are null where the stream has no such value, or the message needs none.
    """
    events, _ = parse_events(messages)
    frames = promote_headers(events.withColumnRenamed("event_json", "value")).select(
        *MESSAGE, F.unix_micros("kafka_ts").alias("micros"), "stream_id", "frame_type", F.coalesce("frame_seq", F.lit(2**62)).alias("frame_seq"),
        *[S.present(F.col(n)).alias(n) for n in _NAMES],
    )
    complete = F.col("route").isNotNull() & F.col("session_id").isNotNull() & F.col("request_id").isNotNull()
    needs = F.col("stream_id").isNotNull() & ((F.col("frame_type") == HEADER_FRAME) | ~complete)
    none = [F.lit(None).cast("string").alias(f"stream_{n}") for n in _NAMES]
    passing = frames.where(~needs).select(*MESSAGE, *none).unionByName(_rejected(messages).select(*MESSAGE, *none))
    keyed = frames.where(needs).select("stream_id", *MESSAGE[:3], "micros", "value", "frame_type", "frame_seq", *_NAMES)
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("stream_id"), F.lit(BUCKETS)).cast("int"))
    keyed = keyed.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds").withColumn("arrived_ms", F.unix_millis("arrived"))
    step = _step(wait_ms, keep_ms)
    found = keyed.groupBy("bucket").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(*MESSAGE[:3], F.timestamp_micros("micros").alias("kafka_ts"), "value", *[f"stream_{n}" for n in _NAMES]).unionByName(passing)


def _rejected(messages: DataFrame) -> DataFrame:
    return parse_events(messages)[1]


def _step(wait_ms: int, keep_ms: int):
    columns = ["kafka_topic", "kafka_partition", "kafka_offset", "micros", "value", "stream_route", "stream_session_id", "stream_request_id"]
    read = ["stream_id", *columns[:5], "frame_type", "frame_seq", *_NAMES]

    def told(stream: dict) -> list[list]:
        """What waits in a stream, with the values known; nothing of it waits any longer."""
        values = [stream["known"][n][1] if n in stream["known"] else None for n in _NAMES]
        frames, stream["waiting"] = stream["waiting"], []
        return [[*f, *values] for f in frames]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Per stream: values, whether its header frame has come, waiting frames, and when it is due.
        streams = json.loads(state.get[0]) if state.exists else {}
        heard, out, now = set(), [], 0
        # Timed out, a bucket has no frames.
        for batch in () if state.hasTimedOut else batches:
            now = max(now, int(batch["arrived_ms"].max()))
            for name, topic, partition, offset, micros, value, kind, seq, *own in zip(*(batch[c].tolist() for c in read), strict=True):
                heard.add(name)
                stream = streams.setdefault(name, {"known": {}, "headed": False, "waiting": [], "due": 0})
                stream["waiting"].append([topic, partition, offset, micros, value])
                stream["headed"] = stream["headed"] or kind == HEADER_FRAME
                known = stream["known"]
                for n, v in zip(_NAMES, own, strict=True):
                    if isinstance(v, str) and (n not in known or seq < known[n][0]):
                        known[n] = [seq, v]
        for name in heard:
            stream = streams[name]
            if stream["headed"]:
                out += told(stream)
            stream["due"] = now + max(1, wait_ms if stream["waiting"] else keep_ms)
        passed = state.getCurrentWatermarkMs()
        for name in [n for n, stream in streams.items() if n not in heard and stream["due"] < passed]:
            # What waited goes on without a header frame; a stream without any is forgotten.
            if streams[name]["waiting"]:
                out += told(streams[name])
                streams[name]["due"] = passed + keep_ms
            else:
                del streams[name]
        if out:
            yield pd.DataFrame(out, columns=columns)
        if streams:
            state.update((json.dumps(streams),))
            state.setTimeoutTimestamp(max(passed + 1, min(stream["due"] for stream in streams.values())))
        else:
            state.remove()

    return step
