"""Helpers that the operators of this subpackage share: input tables and the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BOUND, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Rows of 16 bytes up to which a side is broadcast (32 MB); beyond it the plan shuffles.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Only where that is unset, as in a local test, a folder of this machine takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it is written, not when the driver collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before) if before is not None else spark.conf.unset(FREE_SHUFFLES)


def save(df: DataFrame, name: str, partition_by: str | None = None, **options) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    That cuts the lineage, and a lost executor costs no more than the tasks that read from it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with _shuffles_freed(spark):
        df.write.options(**options).partitionBy(*([partition_by] if partition_by else [])).parquet(path)
    if _recorded is not None:
        _recorded.append(path)
    return spark.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, name: str, key: str, **options) -> DataFrame:
    """save(), in as many buckets by key as a shuffle has partitions: joins by key don't shuffle it."""
    spark = df.sparkSession
    name = f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").options(**options).option("path", path).bucketBy(buckets, key).saveAsTable(name)
    if _recorded is not None:
        _recorded.append(path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and out knows them
    return out


def map_batches(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """df.mapInArrow() with bounded memory in Python workers.

    Batches hold ARROW_BYTES at most, unless the session has its own bound, and a worker, which
    Spark keeps for other tasks, gives free memory back when a task is done.
    """
    if (conf := df.sparkSession.conf).get(ARROW_BOUND) in ("64MB", "67108864b", str(64 << 20)):  # Spark's own default
        conf.set(ARROW_BOUND, str(ARROW_BYTES))

    @wraps(function)
    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return df.mapInArrow(run, schema)


def delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def discard(df: DataFrame, folder: str = "") -> None:
    """Delete the files that save() wrote for df, or one folder of them, once nothing reads them any more."""
    delete(df.sparkSession, sorted({at for f in df.inputFiles() if (at := f.rsplit("/", 1)[0]).endswith(folder)}))


_recorded: list[str] | None = None


@contextlib.contextmanager
def recording(paths: list[str]) -> Iterator[None]:
    """Adds to paths what save() writes meanwhile."""
    global _recorded
    before, _recorded = _recorded, paths
    try:
        yield
    finally:
        _recorded = before


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than that many rows, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of docs with the only column of ids on doc_id; null matches null."""
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids[ids.columns[0]]), how)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
