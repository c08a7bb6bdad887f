"""Stream ingest: parse, embed and append captured frames, each topic offset once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from semdrift.functions.encode import Encoder, embed_events
from semdrift.operators.merge import EVENT_KEY
from semdrift.operators.parse import events_of, parse_messages, rejects_of
from semdrift.streaming.correlate import correlate_messages
from semdrift.streaming.metrics import batch_metrics
from semdrift.streaming.offsets import OffsetTable


@dataclass(frozen=True)
class IngestConfig:
    # Fixed value: idle poll of the capture consumer.
    poll_ms: int = 1000


def append_events(batch: DataFrame, path: str, kept: bool = False) -> None:
    """Append rows whose topic, partition and offset are not stored yet (``offsets.OffsetTable``).

    A batch that comes again stores what is missing of it; stored events are not read. ``kept`` says that ``batch`` is
    persisted or as cheap to read again.
    """
    dated = batch.withColumns(
        {
            "kafka_date": F.to_date("kafka_ts"),
            "has_prompt_embedding": F.col("prompt_embedding").isNotNull(),
        }
    )
    if kept:
        OffsetTable(batch.sparkSession, path).append(dated)
        return
    dated = dated.persist()
    try:
        OffsetTable(batch.sparkSession, path).append(dated)
    finally:
        dated.unpersist()


def run_name(checkpoint: str) -> str:
    """The name under which a checkpoint's batches leave rejects and counts."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def run_ingest(
    messages: DataFrame,
    target: str,
    rejects: str,
    checkpoint: str,
    encoder: Encoder | None = None,
    embed: bool = True,
    trigger: dict | None = None,
    wait_ms: int | None = None,
    metrics: str | None = None,
    windows: Callable[[], DataFrame | None] | None = None,
) -> StreamingQuery:
    """Start the ingest query.

    With ``wait_ms`` frames take route, session and request id of their stream's header frame, also of another
    batch, and wait so long for it (``correlate.correlate_messages``).

    With ``metrics`` every batch leaves its counts there (``metrics.batch_metrics``); ``windows`` is asked in each batch
    for the routes' baseline windows, so that late rows can be told.

    Offsets are committed after the batch is stored; a batch that runs twice
    finds its rows present. With a ``sources.vector_store.VectorStore`` as encoder, texts sent before are not
    encoded again. The batch size is set on the source
    (maxOffsetsPerTrigger, maxFilesPerTrigger).
    """

    # Batches of one checkpoint; another checkpoint writes beside them.
    run = run_name(checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        # Each message is parsed once, for the events, the rejects and the counts.
        parsed = parse_messages(batch).persist()
        try:
            events, bad = events_of(parsed), rejects_of(parsed)
            append_events(embed_events(events, encoder) if embed else events, target, kept=not embed)
            # A repeated batch overwrites its own rejects and counts.
            bad.write.mode("overwrite").parquet(f"{rejects}/run={run}/batch_id={batch_id}")
            if metrics is not None:
                counts = batch_metrics(events, bad, windows() if windows else None)
                counts.coalesce(1).write.mode("overwrite").parquet(f"{metrics}/run={run}/batch_id={batch_id}")
        finally:
            parsed.unpersist()

    if wait_ms is not None:
        messages = correlate_messages(messages, wait_ms)
    trigger = trigger or {"processingTime": f"{IngestConfig.poll_ms} milliseconds"}
    return messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def dedupe_stream(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop repeats inside the stream that arrive within ``delay``."""
    return messages.withWatermark("kafka_ts", delay).dropDuplicatesWithinWatermark(EVENT_KEY)


def envelopes(df: DataFrame) -> DataFrame:
    """Rows as compact JSON messages."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def publish_envelopes(df: DataFrame, options: dict, sink: str = "kafka") -> None:
    """Write one JSON message per row to a topic, or to files with ``sink="text"``."""
    envelopes(df).write.format(sink).options(**options).mode("append").save()
