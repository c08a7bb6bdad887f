"""Helpers that keep plans safe at scale: shared checkpoints and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

# Per-route tables have one short row per route; this many stay far below
# Spark's 8 GB broadcast ceiling.
SMALL_TABLE_ROWS = 1_000_000
# Short tables of plain columns up to this many rows become local ones.
LOCAL_ROWS = 10_000
# Text form of a table that may be broadcast; in memory it takes about as much.
SMALL_TABLE_BYTES = 512 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees, as named by the cluster in spark.checkpoint.dir."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="semdrift-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def row_bytes(row_count: int, dim: int, arrays: int = 1) -> int:
    """Size of ``row_count`` rows that hold ``arrays`` double arrays of length ``dim``."""
    return row_count * dim * arrays * 8


def small_side(df: DataFrame, max_rows: int = SMALL_TABLE_ROWS, stored: bool = False) -> DataFrame:
    """``df`` materialized, with a broadcast hint if its measured size allows one.

    A short table is fetched in one job, at most ``LOCAL_ROWS`` + 1 rows of it,
    and comes back as a local one. A longer one is materialized; its rows are
    counted, and their bytes taken from their text form, so wide arrays count
    in full. Without the hint Spark shuffles both sides and adaptive execution
    splits the hot keys. ``stored`` says that ``df`` is cheap to read again.
    """
    most = min(LOCAL_ROWS, max_rows)
    wide = any(isinstance(f.dataType, ArrayType | MapType | StructType) for f in df.schema)
    if not wide:
        rows = df.limit(most + 1).toArrow()
        if rows.num_rows <= most:
            return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))
    df = df if stored else cut(df)
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
    count, text = df.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if count <= max_rows and text <= SMALL_TABLE_BYTES else df
