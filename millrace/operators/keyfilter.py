"""Bloom filters of keys as tables: a row for each block, built and asked by DataFrame operations.

All bits of a key lie in one block of 32768 bits, so that a filter has as many rows as its keys need,
is built by one aggregate, and is asked by a join on the block.  Nothing of it passes the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, BITS, PROBES = 1 << 15, 16, 4
SCHEMA = "index string, version string, block long, bits binary"


def index(columns: Sequence[str]) -> str:
    return ",".join(columns)


def blocks(rows: int) -> int:
    return max(1, math.ceil(rows * BITS / BLOCK))


def _hashes(columns: Sequence[str]) -> list:
    """h tells the block, g the bits; equal keys have equal ones, nulls being equal."""
    return [F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("g")]


def _bits():
    return F.array(*(F.shiftrightunsigned("g", 15 * i).bitwiseAND(BLOCK - 1) for i in range(PROBES)))


def keys(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """(index, h, g) of the rows' keys in each set of columns."""
    return reduce(DataFrame.unionByName, (rows.select(F.lit(index(s)).alias("index"), *_hashes(s)) for s in sets))


def build(rows: DataFrame, sets: Sequence[Sequence[str]], version: str, n: int) -> DataFrame:
    """Filters for each set of columns of rows, of which there are n."""
    placed = keys(rows, sets).select("index", F.pmod("h", F.lit(blocks(n))).alias("block"), F.explode(_bits()).alias("bit"))
    return placed.groupBy("index", "block").agg(F.bitmap_construct_agg("bit").alias("bits")).select("index", F.lit(version).alias("version"), "block", "bits")


def admitted(spark: SparkSession, filters: DataFrame, asked: DataFrame, sizes: Sequence[tuple[str, str, int]]) -> DataFrame:
    """(index, version, h) of the asked keys (index, h, g) that a filter may hold; sizes: index, version and rows of each filter."""
    known = spark.createDataFrame([(i, v, blocks(n)) for i, v, n in sizes], "index string, version string, blocks long")
    placed = asked.distinct().join(F.broadcast(known), "index").withColumn("block", F.expr("pmod(h, blocks)"))
    held = lambda b: F.expr(f"shiftright(cast(conv(hex(substring(bits, cast({b} div 8 + 1 as int), 1)), 16, 10) as int), cast({b} % 8 as int)) & 1") == 1
    some = placed.withColumn("p", _bits()).join(filters, ["index", "version", "block"])
    return some.where(reduce(lambda a, b: a & b, (held(f"p[{i}]") for i in range(PROBES)))).select("index", "version", "h")
