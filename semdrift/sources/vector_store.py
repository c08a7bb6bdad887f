"""Vectors kept by the hash of their text, so that a text is encoded once, however often it is sent."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.functions.encode import Encoder

SCHEMA = "key string, vector array<float>, bucket int"
LOG_SCHEMA = "folder string, published_at timestamp"


@dataclass(frozen=True)
class VectorStore:
    """An encoder that asks ``encoder`` only for texts it has not stored: usable wherever an encoder is.

    ``name`` says which model the vectors come from; each model has its own folder. Prompts and completions differ by
    their prefix, so they are keyed apart. Equal texts of a table are encoded once. A null text has a null vector; an
    empty one is a text.

    Calling it runs a job that stores what is missing. A crash leaves either whole files or none; a batch that runs
    again finds them, and texts that two writers store at once are read once. ``compact`` may run beside readers and
    writers: what is stored meanwhile is encoded again when it is next met.
    """

    path: str
    name: str
    encoder: Encoder
    buckets: int = 256

    def __call__(self, df: DataFrame, text: str, out: str) -> DataFrame:
        key = F.sha2(F.col(text), 256)
        told = F.col(text).isNotNull()
        asked = df.where(told).select(key.alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
        asked = asked.withColumn("bucket", self._bucket("key")).persist()
        try:
            # At most one number per bucket.
            buckets = [r[0] for r in asked.select("bucket").distinct().collect()]
            stored = self.stored(df.sparkSession)
            known = stored.where(F.col("bucket").isin(buckets)).select("bucket", "key")
            missing = asked.join(known, ["bucket", "key"], "left_anti")
            if buckets and not missing.isEmpty():
                self._store(missing)
        finally:
            asked.unpersist()
        keys = df.where(told).select(key.alias("_key")).distinct()
        found = self.stored(df.sparkSession).where(F.col("bucket").isin(buckets))
        found = found.join(keys, F.col("key") == F.col("_key"), "left_semi").groupBy(F.col("key").alias("_key")).agg(F.first("vector").alias(out))
        plain = df.drop(out)
        with_text = plain.where(told).withColumn("_key", key).join(found, "_key", "left").select(*plain.columns, out)
        # Rows without a text meet nobody in the join.
        return with_text.unionByName(plain.where(~told).withColumn(out, F.lit(None).cast("array<float>")))

    def stored(self, spark: SparkSession) -> DataFrame:
        """(key, vector, bucket) of all stored texts; a key may be there twice."""
        try:
            return spark.read.schema(SCHEMA).parquet(self._folder(spark))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], SCHEMA)

    def compact(self, spark: SparkSession) -> None:
        """Rewrite the store with one file per bucket and one row per key, then point readers to it."""
        folder = uuid.uuid4().hex
        one = self.stored(spark).groupBy("bucket", "key").agg(F.first("vector").alias("vector"))
        self._write(one, f"{self._home}/{folder}")
        line = spark.range(1).select(F.lit(folder).alias("folder"), F.current_timestamp().alias("published_at"))
        line.coalesce(1).write.mode("append").parquet(f"{self._home}/current")

    @property
    def _home(self) -> str:
        return f"{self.path}/{self.name}"

    def _folder(self, spark: SparkSession) -> str:
        try:
            newest = spark.read.schema(LOG_SCHEMA).parquet(f"{self._home}/current").orderBy(F.desc("published_at"), "folder").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None
        return f"{self._home}/{newest['folder'] if newest else 'first'}"

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")

    def _store(self, missing: DataFrame) -> None:
        vectors = self.encoder(missing, "text", "vector").select("key", F.col("vector").cast("array<float>"), "bucket")
        self._write(vectors, self._folder(missing.sparkSession))

    def _write(self, vectors: DataFrame, folder: str) -> None:
        vectors.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("append").partitionBy("bucket").parquet(folder)
