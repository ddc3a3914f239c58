"""Tables that are written once and read again, and sides of joins whose size is checked."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; beyond it the plan shuffles.
BROADCAST_ROWS = 500_000
#: Rows of a partition that dealt() makes; it bounds what one task sorts.
TASK_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of this machine only where all runs in one JVM."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder: evaluated once, whatever reads it."""
    return kept(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}")


def observed(df: DataFrame, path: str, measures: dict[str, Column], drop: Sequence[str] = ()) -> tuple[DataFrame, dict[str, int]]:
    """df from a table written at path, without some columns, and aggregates taken by the tasks that wrote it."""
    if not measures:
        return kept(df.drop(*drop), path), {}
    seen = Observation()
    out = kept(df.observe(seen, *(m.alias(n) for n, m in measures.items())).drop(*drop), path)
    return out, seen.get


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than that many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by keys, over more partitions the more rows it has, so that tasks stay of one size.

    Partitions that Spark coalesces only stop growing at its advisory size, which is one of compressed bytes.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
