"""Window operators: keep-first, tiers, scaling, lags, moving averages, top-n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import storage

Order = Sequence[str | Column]


def mark_repeats(df: DataFrame, keys: Sequence[str], order: Order, name: str = "repeat") -> DataFrame:
    """df with a boolean: is the row not the first of its key, nulls being equal?"""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def keep_first(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    return mark_repeats(df, keys, order, "_repeat").where("not _repeat").drop("_repeat")


def top_n(df: DataFrame, n: int, by: Sequence[str], order: Order, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; order must be total."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def rank_all(df: DataFrame, order: Sequence[str], rank: str = "rank") -> DataFrame:
    """Ranks over the whole table without bringing it to one task; order should be total.

    Rows are dealt out by ranges of the order and sorted within them, once: ranges are drawn from
    samples, so that a second evaluation may deal differently.  The id that Spark gives each row
    then holds its range and its place there, and only the counts of the ranges are added up.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = storage.written(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("_part", part).join(storage.small(counts.select("_part", before.alias("_before"))), "_part")
    return placed.withColumn(rank, F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).drop("_id", "_part", "_before")


def tiers(df: DataFrame, order: Sequence[str], labels: Sequence[str], name: str = "tier") -> DataFrame:
    """Equal-frequency tiers of the rows in order.

    With n rows, rank r is in the first tier i of k for which k * (r - 1) < i * (n - 1), else in
    the last.
    """
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    ranked = rank_all(df, order, "_rank").join(F.broadcast(total))
    k, at = len(labels), F.col("_rank") - 1
    out: Column = F.lit(labels[-1])
    for i in range(k - 1, 0, -1):
        out = F.when(at * k < i * (F.col("_total") - 1), labels[i - 1]).otherwise(out)
    return ranked.withColumn(name, out).drop("_rank", "_total")


def group_minmax(value: Column, by: Sequence[str]) -> Column:
    """value scaled to 0..1 within its group; a constant group gives 0, null stays null."""
    low, high = F.min(value).over(Window.partitionBy(*by)), F.max(value).over(Window.partitionBy(*by))
    return F.when(high > low, (value - low) / (high - low)).otherwise(value * 0)


def moving_average(value: Column, by: Sequence[str], order: Order, rows: int) -> Column:
    return F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0))


def lagged(value: Column, by: Sequence[str], order: Order, rows: int) -> Column:
    return F.lag(value, rows).over(Window.partitionBy(*by).orderBy(*order))


def band_mean(value: Column, by: Sequence[str], day: Column, reach: int, where: Column) -> Column:
    """Mean over rows of the same group within so many days on either side, where a condition holds."""
    near = Window.partitionBy(*by).orderBy(F.unix_date(day)).rangeBetween(-reach, reach)
    return F.avg(F.when(where, value)).over(near)


def first_filled(column: str, by: Sequence[str], order: Order) -> Column:
    """The group's first value in order that is not null."""
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(column, ignorenulls=True).over(whole)


def scaled(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None, suffix: str = "_z") -> DataFrame:
    """Population z-scores of columns, fitted on train (df by default); a constant column gives 0."""
    stats = (train if train is not None else df).agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.join(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c + suffix, F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.col(c) * 0))
    return out.drop(*stats.columns)
