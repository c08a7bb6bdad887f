"""Reading captured frames: the topic stream, envelope files and the stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a source must deliver per message besides Kafka's own names.
MESSAGE_SCHEMA = "topic string, partition int, offset bigint, timestamp timestamp, value string"


def read_capture_stream(spark: SparkSession, options: dict, source: str = "kafka") -> DataFrame:
    """Stream of captured messages: kafka_topic, kafka_partition, kafka_offset, kafka_ts, value.

    ``source`` may name any file format whose rows follow ``MESSAGE_SCHEMA``.
    """
    reader = spark.readStream.format(source)
    if source == "kafka":
        reader = reader.option("startingOffsets", "earliest")
    else:
        reader = reader.schema(MESSAGE_SCHEMA)
    return as_messages(reader.options(**options).load())


def as_messages(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_ts"),
        F.col("value").cast("string").alias("value"),
    )


def millis_to_ts(col):
    """Kafka's epoch milliseconds as a timestamp."""
    return F.timestamp_millis(col)


def read_capture_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Envelope lines of a text file, blank lines skipped."""
    return envelope_lines(spark.read.text(path))


def envelope_lines(df: DataFrame) -> DataFrame:
    return df.where(F.trim("value", F.lit(" \t\r\n")) != "")


def load_events(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Stored events; name the columns needed so that only they are read."""
    events = spark.read.parquet(path)
    return events.select(*columns) if columns else events
