"""Exact dedup with an extendible-hash index on shared files (DataFrame functions only).

Texts are equal when they are identical after each run of ASCII white space became one space.

1. One scan writes a record for each document into the shared folder: doc_id, the hash of its
   normalised text, the text's SHA-256.
2. The records' distinct hashes, counted with map-side combining, are the entries of the index.
   Its directory starts with one bit of the hash for each so many entries and doubles as long as a
   bucket holds more than `capacity` entries; only overfull buckets split.  A bucket is a range of
   hashes; the entries are written sorted by bucket, each owner task writing a range of them.
3. Hashes that several documents share are collisions.  Their texts are read again and chained:
   within a hash, texts are grouped by their bytes, so that two texts with one hash get two links
   of the chain.  Equal texts combine before they are sent.  Links, which hold no text, go to the
   owners of the buckets' ranges and are written there.
4. Each document looks up its bucket in the directory and finds its link there by hash and
   SHA-256; a hash met once needs no link.

No step holds a group of copies in one task: groups exist as counts and a smallest doc_id.

Edge cases: null text counts as empty, and all empty texts are one group; a null doc_id orders
before all others and is kept like them; rows repeated as a whole share their doc_id, count
each, and all of them are marked as kept if their doc_id is the one that stays (keep() leaves
one of them).  An empty table gives an empty result.  Columns besides doc_id and text are
ignored by groups() and returned by keep().
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common

#: Entries a bucket may hold before it splits.
CAPACITY = 1 << 12
#: Rows of about 100 bytes up to which the dropped documents are broadcast.
DROPPED_ROWS = 300_000


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(common.text_or_empty(column), r"[\x20\x09-\x0D]+", " ")


def _start(bits: int) -> Column:
    """The hash with all but its first bits cleared: where its bucket of that depth starts."""
    return F.shiftleft(F.shiftrightunsigned("h", 64 - bits), 64 - bits) if bits else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Buckets (depth, bucket) of the entries' hashes; each holds `capacity` entries at most.

    bucket is the first hash of its range.  A round counts the entries of each range; those that
    fit become buckets, overfull ones split on one more bit.  Hashes are distinct, so that splitting
    ends.
    """
    total = entries.count()
    depth = max(0, math.ceil(math.log2(max(1, total / capacity))))
    buckets, rest = None, entries.select("h")
    while True:
        counts = rest.groupBy(_start(depth).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        counts = common.save(counts, f"directory-{depth}")
        fit = counts.where(F.col("n") <= capacity).select(F.lit(depth).alias("depth"), "bucket")
        buckets = fit if buckets is None else buckets.unionByName(fit)
        over = counts.where(F.col("n") > capacity)
        if depth == 64 or over.isEmpty():
            return common.save(buckets, "directory")
        rest = rest.join(common.small(over.select("bucket")), _start(depth) == F.col("bucket"), "left_semi")
        depth += 1


def in_buckets(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """Adds `bucket` to rows with a hash: of its ranges of all depths, the one in the directory."""
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())  # 65 rows at most
    ranges = F.array(*(F.struct(F.lit(d).alias("depth"), _start(d).alias("bucket")) for d in depths or [0]))
    spread = entries.select("*", F.explode(ranges).alias("_range"))
    found = spread.select(*entries.columns, F.col("_range.depth").alias("depth"), F.col("_range.bucket").alias("bucket"))
    return found.join(common.small(buckets), ["depth", "bucket"]).select(*entries.columns, "bucket")


def groups(docs: DataFrame, capacity: int = CAPACITY, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """For every row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket."""
    texts = docs.select("doc_id", normalised().alias("norm")).withColumn("h", hashed(F.col("norm")))
    records = common.save(texts.select("doc_id", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "records")
    entries = common.save(records.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "entries")
    buckets = directory(entries, capacity)
    index = common.save(in_buckets(entries, buckets).repartitionByRange("bucket").sortWithinPartitions("bucket", "h"), "index")
    chained = texts.join(common.small(index.where("n > 1").select("h", "bucket")), "h")
    links = (
        chained.groupBy("bucket", "h", "norm")
        .agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nameless"), F.count(F.lit(1)).alias("n"))
        .select("bucket", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.when(~F.col("nameless"), F.col("least")).alias("keep"), "n")
    )
    chains = common.save(links.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "text_sha256"), "chains")
    found = in_buckets(records, buckets).join(chains, ["bucket", "h", "text_sha256"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256", "bucket")


def keep(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were.

    Rows repeated with one doc_id and text are reduced to one of them as well.
    """
    found = groups(docs, capacity)
    same = lambda a, b: a["_id"].eqNullSafe(b["doc_id"]) & (a["_sha"] == b["text_sha256"])
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.sha2(normalised().cast("binary"), 256).alias("_sha"))
    dropped = common.save(found.where("not kept").select("doc_id", "text_sha256").distinct(), "dropped")
    stay = keyed.join(common.small(dropped, DROPPED_ROWS), same(keyed, dropped), "left_anti")
    repeated = common.save(found.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1").drop("count"), "repeated-rows")
    if repeated.isEmpty():
        return stay.select("row.*")
    once = stay.join(repeated, same(stay, repeated), "left_anti")
    again = stay.join(repeated, same(stay, repeated), "left_semi").groupBy("_id", "_sha").agg(F.min("row").alias("row"))
    return once.select("row.*").unionByName(again.select("row.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents")).drop("bucket")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
