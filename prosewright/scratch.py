"""Tables written once and read often, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most bytes that a broadcast side may have, as counted rows times a bound on the bytes of a row.
BROADCAST_BYTES = 24 << 20
_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return _local[app]


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: what reads it repeats no work, and lost executors cost none of what is written."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_size(df: DataFrame, rows: int, width: int = 128) -> DataFrame:
    """df, to be broadcast if its counted rows, of at most width bytes each, are within BROADCAST_BYTES; else the
    optimizer weighs it."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df
