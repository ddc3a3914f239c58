"""Shards of nearly equal size from sampled splitters.

1. One scan writes a record for each document into the shared folder: its size, what is carried
   along, and its key.  A key is the hash of the text, that of doc_id and the record's number in
   the written table, so that equal texts lie together and no two keys are equal.
2. Keys are drawn with a chance that grows with the document's size (one for each so many bytes, a
   document of at least that size always); quantiles of their weights are the boundaries of ranges,
   moved to where a group of equal texts starts.  The number of ranges grows with the bytes, from
   RANGES for each shard up to MOST.
3. Ranges are counted exactly.  Those of over twice their share and several records are overfull:
   further keys are drawn within them and split them, until none is left.  A group of equal texts
   that fills a range by itself, however large, splits as well, since keys are distinct.
4. Each range is one task's work: records are sorted by key, with running counts and bytes.  With
   what lies before the range, which the driver adds up from the counts of ranges, each document
   gets its exact place in the whole order.  Shards are equal stretches of that order in bytes.  A
   document goes where its middle byte falls; a group of equal texts within one range of at most
   1 / WHOLE of a shard goes where the group's middle byte falls, so that such groups stay together.

A shard's size differs from an equal share by no more than a document and 1 / WHOLE of a share.
The law is `bytes`; sizes are the UTF-8 bytes of the text plus OVERHEAD.

Edge cases: null text has the size OVERHEAD and the checksum of no bytes; a null doc_id is a value
like others; repeated rows are records of their own; an empty table gives an empty result; with
fewer documents than shards some shards are empty.  Extra columns are carried in one struct, so that
their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm import common

SHARDS, OVERHEAD = 24, 8
#: Ranges for each shard at least, bytes of a range beyond that, and ranges at most (48 bytes each in a task's closure).
RANGES, RANGE_BYTES, MOST = 16, 256 << 20, 1 << 16
#: Keys drawn for each range.
DRAWN = 16
#: Groups of at most that part of a shard stay whole.
WHOLE = 64
KEY = 24


def _key(h: Column) -> Column:
    """24 bytes in the order of (hash of text, hash of doc_id, number)."""
    parts = [h, F.xxhash64("doc_id"), F.monotonically_increasing_id()]
    return F.unhex(F.concat(*(F.lpad(F.hex(p), 16, "0") for p in parts)))


def _drawn(records: DataFrame, every: Column, seed: int) -> np.ndarray:
    """Keys and weights of a sample: one key for each so many bytes (every).

    The choice hangs on the key alone, so that a task that runs again draws the same.
    """
    chance = (F.xxhash64(F.lit(seed), "key").bitwiseAND((1 << 52) - 1)) / float(1 << 52)
    found = records.where(chance * every < F.col("size")).select("key", F.greatest(F.col("size").cast("double"), every).alias("weight")).toPandas()
    return np.array([(bytes(k), w) for k, w in zip(found["key"], found["weight"])], [("key", f"S{KEY}"), ("weight", "f8")])


def _quantiles(drawn: np.ndarray, ranges: int) -> np.ndarray:
    """Boundaries of that many ranges of nearly equal weight; each starts a range."""
    drawn = np.sort(drawn, order="key")
    total = np.cumsum(drawn["weight"])
    if not len(total):
        return drawn["key"]
    at = np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges, "right")
    return np.unique(drawn["key"][np.minimum(at, len(drawn) - 1)])


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the groups of equal texts of the keys start."""
    return np.unique(keys.astype("S8").astype(f"S{KEY}"))


def _in_ranges(records: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds `range`, the number of splitters up to the record's key."""

    def run(batches):
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), f"S{KEY}")
            place = np.searchsorted(splitters, keys, "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "range"])

    return common.map_batches(records, run, StructType([*records.schema, StructField("range", LongType())]))


def splitters(records: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries (keys) that leave no range overfull, and (rows, bytes) of each range."""
    rows, size = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(max(RANGES * shards, size // RANGE_BYTES), MOST)
    share = max(1.0, size / ranges)
    found, seed = _starts(_quantiles(_drawn(records, F.lit(share / DRAWN), 0), ranges)), 0
    keyed = records.select("key", "size")
    while True:
        placed = _in_ranges(keyed, found)
        counts = np.zeros((len(found) + 1, 2), np.int64)
        for r in placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect():  # a row for each range
            counts[r["range"]] = r["n"], r["size"]
        over = np.flatnonzero((counts[:, 1] > 2 * share) & (counts[:, 0] > 1))
        if len(over) == 0:
            return found, counts
        seed += 1
        inside = placed.join(common.small(records.sparkSession.createDataFrame([(int(i),) for i in over], "range long")), "range", "left_semi")
        more = _drawn(inside, F.lit(share / DRAWN), seed)
        of = np.searchsorted(found, more["key"], "right")
        parts = []
        for i in over:
            inner, low = _quantiles(more[of == i], int(np.ceil(counts[i, 1] / share))), found[i - 1] if i else b""
            groups = (s := _starts(inner))[s > low]
            parts.append(groups if len(groups) else inner)  # within a group where that is all the range holds
        new = np.unique(np.concatenate([found, *parts]))
        if len(new) == len(found):  # one document makes up nearly all of each
            return found, counts
        found = new


def placed(docs: DataFrame, shards: int = SHARDS, carry: Column | None = None) -> DataFrame:
    """carry (all columns of docs by default, as the struct `row`), size, shard, slot and range for each row."""
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    carried = (F.struct("*") if carry is None else carry).alias("row")
    size = (F.coalesce(F.length(text), F.lit(0)) + OVERHEAD).cast("long")
    records = common.save(docs.select(carried, size.alias("size"), F.xxhash64("text").alias("h"), _key(F.xxhash64("text")).alias("key")), "shard-records")
    bounds, counts = splitters(records, shards)
    total = max(1, int(counts[:, 1].sum()))
    before = np.cumsum(counts, axis=0) - counts
    ranges = common.small(spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(before)], "range long, rows_before long, bytes_before long"), MOST * 4)
    by_key, group = Window.partitionBy("range").orderBy("key"), Window.partitionBy("range", "h")
    ordered = _in_ranges(records, bounds).withColumns({"at": F.row_number().over(by_key) - 1, "to": F.sum("size").over(by_key)})
    ordered = ordered.withColumns({"group_bytes": F.sum("size").over(group), "group_from": F.min(F.col("to") - F.col("size")).over(group)})
    whole = F.col("group_bytes") * (WHOLE * shards) <= total
    middle = F.when(whole, 2 * F.col("group_from") + F.col("group_bytes")).otherwise(2 * F.col("to") - F.col("size"))
    # decimals: the product of bytes and shards may be beyond a long
    shard = F.expr(f"cast(least({shards - 1}, (2 * bytes_before + middle) * cast({shards} as decimal(10, 0)) div cast({2 * total} as decimal(20, 0))) as int)")
    found = ordered.withColumn("middle", middle).join(ranges, "range").withColumn("shard", shard).withColumn("place", F.col("rows_before") + F.col("at"))
    found = common.save(found.select("row", "size", "shard", "place", "range"), "shard-places")
    first = found.groupBy("shard").agg(F.min("place").alias("first"))
    return found.join(F.broadcast(first), "shard").select("row", "size", "shard", (F.col("place") - F.col("first")).alias("slot"), "range")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with size, shard and slot (gapless in each shard, from 0); names that docs has already give way."""
    found = placed(docs, shards)
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("size", "shard", "slot")), "size", "shard", "slot")


def write(docs: DataFrame, folder: str, shards: int = SHARDS, writer: Callable = lambda w: w) -> DataFrame:
    """Write docs below folder, a folder for each shard, rows of each file by slot; what shard() gives, read back."""
    found = placed(docs, shards).repartitionByRange("shard", "range", "slot").sortWithinPartitions("shard", "slot")
    out = found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("size", "shard", "slot")), "size", "slot", "shard")
    writer(out.write.mode("errorifexists").partitionBy("shard")).parquet(folder)
    return docs.sparkSession.read.schema(out.schema).parquet(folder)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    digest = F.struct("doc_id", F.crc32(common.text_or_empty().cast("binary")).cast("long").alias("text_crc32"))
    found = placed(docs, carry=digest)
    return found.select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
