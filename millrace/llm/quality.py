"""Importance resampling of documents towards a target: hashed n-gram models and Gumbel top-k.

Unigrams and bigrams of words, which white space parts, are hashed into buckets; a text counts once in each of its buckets,
since a word that one text repeats says nothing about others.  The counts in the target's documents and
in all documents are two generative models; a document's log weight is the sum of the log ratios
of its n-grams' buckets.  A bucket's ratio is drawn towards 1 by imaginary texts, PRIOR of all texts,
so that no n-gram decides alone, and a document's own n-grams are left out of both counts, so that
being labelled is no merit in itself.  The log ratio of a bucket counts only if its texts in the
target differ by SIGMAS standard deviations from what chance gives, however rare it is; the others
are noise, which would add up to the document's length.  To each log weight goes Gumbel noise, made from the document's
own hash, and the k documents of the largest sums are the sample: drawing k documents without
replacement in proportion to their weights.

By default k is the number of documents whose log weight, without noise, is one that all of the
target but the share FLOOR reach.  Where no n-gram is significant, that is every document.

Tasks count into vectors of fixed size and send what they hold in each bucket; the sums of all
buckets, whose number is a parameter, go to the driver, whatever the corpus.  The k-th largest sum is found by counting leading bits, not by
sorting.

Edge cases: null or empty text and text without words weigh 0; a null doc_id cannot be labelled,
but is sampled; rows of the same doc_id and text get the same noise; ties at the k-th place are
all sampled.  Without target documents all weights are 0.  Empty tables give an empty result.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, textcodes

#: Buckets for each length of n-gram.
BUCKETS = 1 << 17
N = 2
#: Shares: of all texts, and of the target's documents.
PRIOR = 0.0005
FLOOR = 0.05
SIGMAS = 3.0


def _features(batch: pa.RecordBatch, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of the n-grams of each of a batch's texts, and the rows."""
    words, at = textcodes.word_codes(*textcodes.buffer_of(batch.column("text")), textcodes.NOT_SPACE)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    codes, rows, gram = [], [], words
    for k in range(n):
        if k:
            gram = textcodes.mix(gram[: len(gram) - 1] * np.uint64(3) + words[k:]) if len(gram) else gram
        start, end = row[: len(gram)], row[len(row) - len(gram) :]
        own = start == end
        codes.append((gram[own] % np.uint64(buckets)).astype(np.int64) + k * buckets)
        rows.append(start[own])
    both = np.unique(np.concatenate(rows) * (n * buckets) + np.concatenate(codes))
    return both % (n * buckets), both // (n * buckets)


def _counter(n: int, buckets: int):
    def count(batches):
        target, raw = np.zeros(n * buckets + 1, np.int64), np.zeros(n * buckets + 1, np.int64)
        for batch in chain.from_iterable(map(textcodes.slices, batches)):
            codes, rows = _features(batch, n, buckets)
            own = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)[rows] if len(rows) else np.zeros(0, bool)
            raw += np.bincount(codes, minlength=len(raw))
            target += np.bincount(codes[own], minlength=len(raw))
            target[-1] += pc.sum(batch.column("target")).as_py() or 0
            raw[-1] += batch.num_rows
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(target[at]), pa.array(raw[at])], ["bucket", "target", "raw"])

    return count


def models(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of each bucket, and last of texts, in the target and in all of docs, which has text and target (boolean)."""
    parts = docs.select("text", "target").transform(common.map_batches, _counter(n, buckets), "bucket long, target long, raw long")
    out = np.zeros((2, n * buckets + 1), np.int64)
    for bucket, target, raw in parts.groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect():  # a row for each bucket at most
        out[:, bucket] = target, raw
    return out


def _weigher(counts: np.ndarray, n: int, buckets: int):
    def weigh(batches):
        (target, raw), prior = counts[:, :-1], PRIOR * counts[1, -1]
        share = np.repeat(target.reshape(n, -1).sum(axis=1) / np.maximum(raw.reshape(n, -1).sum(axis=1), 1), buckets)
        for batch in chain.from_iterable(map(textcodes.slices, batches)):
            codes, rows = _features(batch, n, buckets)
            own = batch.column("target").to_numpy(zero_copy_only=False).astype(int)[rows] if len(rows) else rows
            found, expected = target[codes] - own, (raw[codes] - 1) * share[codes]
            ratio = np.log((found + prior) / (expected + prior)) if target.any() else np.zeros(len(codes))
            ratio[np.abs(found - expected) < SIGMAS * np.sqrt(expected * (1 - share[codes]))] = 0
            weight = np.bincount(rows, weights=ratio, minlength=batch.num_rows)
            size = np.bincount(rows, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("target"), batch.column("noise"), pa.array(weight.astype(np.float64)), pa.array(size.astype(np.int64))], ["doc_id", "target", "noise", "log_weight", "n_grams"])

    return weigh


def gumbel(*columns: str) -> Column:
    """Gumbel noise from a hash of columns."""
    uniform = (F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)
    return -F.log(-F.log(uniform))


def _kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the column key, by its leading bits."""
    # bits in the order of the numbers they stand for
    low, high, at = keys.agg(F.min("key"), F.max("key")).first() + (k,)
    while low < high:
        width = (high - low) / 4096
        place = F.least(F.lit(4095), F.floor((F.col("key") - low) / width)) if width > 0 else F.lit(0)
        within = keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(within.collect(), reverse=True):  # 4096 rows at most
            if at <= row["n"]:
                if (row["low"], row["high"]) == (low, high):
                    return low
                low, high = row["low"], row["high"]
                break
            at -= row["n"]
    return low


def _default_size(weighed: DataFrame) -> int:
    target = weighed.where("target").select(F.col("log_weight").alias("key"))
    n = target.count()
    floor = _kth_largest(target, ceil((1 - FLOOR) * n)) if n else float("-inf")
    return weighed.where(F.col("log_weight") >= floor).count()


def resample(docs: DataFrame, k: int | None = None, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, log_weight, n_grams, key (with noise) and sampled, for docs (doc_id, text, target)."""
    counts = models(docs, n, buckets)
    noisy = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "target", gumbel("doc_id", "text").alias("noise"))
    weighed = noisy.transform(common.map_batches, _weigher(counts, n, buckets), "doc_id long, target boolean, noise double, log_weight double, n_grams long")
    weighed = common.save(weighed.withColumn("key", F.col("log_weight") + F.col("noise")), "weights")
    size = _default_size(weighed) if k is None else k
    least = _kth_largest(weighed, size) if 0 < size <= weighed.count() else float("-inf" if size else "inf")
    return weighed.select("doc_id", "log_weight", "n_grams", "key", (F.col("key") >= least).alias("sampled"))


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality and not toxic."""
    good = common.table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id").distinct().withColumn("target", F.lit(True))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").join(common.small(good), "doc_id", "left")
    return resample(docs.withColumn("target", F.coalesce("target", F.lit(False)))).withColumnRenamed("sampled", "kept")
