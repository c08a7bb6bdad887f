"""Which topic offsets are stored, as merged intervals beside the events.

Intervals are kept per topic, partition and bucket of 2 ** ``BUCKET_BITS`` offsets, so looking an offset up is a join
on its bucket with a table of about one row per bucket, whatever the number of stored events. A batch of events goes
to a new folder. Around it two versions of the table are written: one that names the folder as begun, and one with
the batch's offsets. If a writer dies in between, the next one finds a begun folder and counts what is in it, so a
batch that comes again stores only what is missing. One writer at a time, as for any append to a folder. Rows without
a topic, partition or offset are never taken for stored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semdrift.scale import small_side

BUCKET_BITS = 20
KEY = ["kafka_topic", "kafka_partition"]
_SCHEMA = "kafka_topic string, kafka_partition int, bucket long, low long, high long, begun string"
# Versions that are kept for readers that have just looked.
KEPT_VERSIONS = 4


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def intervals_of(offsets: DataFrame) -> DataFrame:
    """(topic, partition, bucket, low, high): runs of consecutive offsets within each bucket."""
    known = offsets.where("kafka_topic is not null and kafka_partition is not null and kafka_offset is not null")
    once = known.select(*KEY, F.shiftright("kafka_offset", BUCKET_BITS).alias("bucket"), F.col("kafka_offset").alias("low"), F.col("kafka_offset").alias("high"))
    return merged(once.distinct())


def merged(intervals: DataFrame) -> DataFrame:
    """Touching and overlapping intervals of a bucket as one."""
    order = Window.partitionBy(*KEY, "bucket").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("opens", F.coalesce(F.col("low") > reach + 1, F.lit(True)).cast("int"))
    run = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*KEY, "bucket", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def not_covered(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows whose offset is in no interval."""
    held = intervals.select(*[F.col(c).alias(f"_{c}") for c in (*KEY, "bucket", "low", "high")])
    inside = F.col("kafka_offset").between(F.col("_low"), F.col("_high"))
    same = (F.col("kafka_topic") == F.col("_kafka_topic")) & (F.col("kafka_partition") == F.col("_kafka_partition"))
    return rows.join(small_side(held, stored=True), same & (F.shiftright("kafka_offset", BUCKET_BITS) == F.col("_bucket")) & inside, "left_anti")


class OffsetTable:
    """The interval table of one folder of events."""

    def __init__(self, spark: SparkSession, events: str) -> None:
        self.spark, self.events, self.path = spark, events, f"{events}/_offsets"
        self.version, self.begun = self._latest()

    def _latest(self) -> tuple[int, str | None]:
        stored = read_or_none(self.spark, self.path)
        top = None if stored is None else stored.groupBy("v").agg(F.max("begun").alias("begun")).orderBy(F.desc("v")).first()
        return (0, None) if top is None else (int(top["v"]), top["begun"])

    def _kept(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], _SCHEMA).drop("begun")
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/v={self.version}").where("low is not null").drop("begun")

    def intervals(self) -> DataFrame:
        """What is stored, with the offsets of a folder that was begun and not finished."""
        left = None if self.begun is None else read_or_none(self.spark, f"{self.events}/batch={self.begun}")
        return self._kept() if left is None else merged(self._kept().unionByName(intervals_of(left)))

    def write(self, intervals: DataFrame, begun: str | None) -> None:
        """The next version, in one file, so that it is there as a whole or not at all."""
        mark = self.spark.createDataFrame([(None, None, None, None, None, begun)], _SCHEMA)
        rows = intervals.withColumn("begun", F.lit(begun)).unionByName(mark)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v={self.version + 1}")
        self.version, self.begun = self.version + 1, begun
        self._forget(self.version - KEPT_VERSIONS)

    def _forget(self, version: int) -> None:
        if version > 0:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={version}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def _has_date_folders(self) -> bool:
        """Whether batches are stored in a folder per date, as they once were; Spark reads no folder that mixes both."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.events)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        batches = fs.listStatusIterator(root)
        while batches.hasNext():
            batch = batches.next().getPath()
            held = fs.listStatusIterator(batch) if batch.getName().startswith("batch=") else None
            while held is not None and held.hasNext():
                name = held.next().getPath().getName()
                if not name.startswith(("_", ".")):
                    return name.startswith("kafka_date=")
        return False

    def append(self, rows: DataFrame) -> None:
        """Store the rows whose offsets are not stored yet, each offset once, in a new folder."""
        folder = uuid.uuid4().hex
        before = self.intervals()
        fresh = not_covered(rows.dropDuplicates([*KEY, "kafka_offset"]), before)
        self.write(before, folder)
        # By ranges of the dates: one file per task, whatever the number of dates, and a long date is dealt out. Sorted,
        # so that a filter on the date skips files and row groups by their statistics.
        order = ["kafka_date", "kafka_partition", "kafka_offset"]
        writer = fresh.repartitionByRange(*order).sortWithinPartitions(*order).write
        if self._has_date_folders():
            writer = writer.partitionBy("kafka_date")
        writer.parquet(f"{self.events}/batch={folder}")
        self.write(merged(self._kept().unionByName(intervals_of(rows))), None)
