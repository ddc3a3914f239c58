"""Outlier detectors over one column, or several for the isolation forest."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import storage


def zscore(df: DataFrame, value: str, limit: float = 3.0, name: str = "zscore") -> DataFrame:
    """Flag where value is more than so many sample standard deviations off the mean."""
    stats = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    flag = F.coalesce(F.abs(F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))) > limit, F.lit(False))
    return df.join(F.broadcast(stats)).withColumn(name, flag).drop("_m", "_s")


#: Parts of a range that a round of selection counts, and values that are few enough to be listed.
PARTS, FEW = 1 << 12, 1 << 12


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at these places (from 0) of a column in order, nulls and NaN left out; exact.

    Selection by counting: each round counts the values in parts of the ranges where the places still
    are, with the least and greatest value of each part, and goes on in the parts that hold them.  A
    round's result has PARTS rows for each place, whatever the table holds.
    """
    values = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    finite, least = F.abs("v") < math.inf, F.count_if(F.col("v") == -math.inf)
    every, below, n, low, high = values.agg(F.count(F.lit(1)), least, F.count_if(finite), F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v")))).first()
    found: dict[int, float] = {r: -math.inf if r < below else math.inf for r in ranks if 0 <= r < every and not below <= r < below + n}
    values = values.where(finite)
    spans = {(low, high, below, n): [r for r in ranks if below <= r < below + n]} if n else {}
    while spans:
        after: dict[tuple, list[int]] = {}
        sides = {s: i for i, s in enumerate(spans)}
        few = [s for s in spans if s[3] <= FEW]
        for s in (s for s in spans if s[0] == s[1]):
            found |= {r: s[0] for r in spans[s]}
            sides.pop(s)
        for s in (s for s in few if s in sides):
            listed = sorted(r["v"] for r in values.where(F.col("v").between(s[0], s[1])).collect())
            found |= {r: listed[r - s[2]] for r in spans[s]}
            sides.pop(s)
        if sides:
            at = F.lit(None).cast("int")
            for s, i in sides.items():  # halves of values: a difference may be beyond a double
                part = F.floor((F.col("v") / 2 - s[0] / 2) / (s[1] / 2 - s[0] / 2) * PARTS).cast("int")
                at = F.when(F.col("v").between(s[0], s[1]), F.lit(i * (PARTS + 1)) + F.least(part, F.lit(PARTS))).otherwise(at)
            counted = values.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("at is not null").orderBy("at").collect()
            for s, i in sides.items():
                before = s[2]
                for r in (r for r in counted if r["at"] // (PARTS + 1) == i):
                    if held := [k for k in spans[s] if before <= k < before + r["n"]]:
                        after[r["low"], r["high"], before, r["n"]] = held
                    before += r["n"]
        spans = after
    return found


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a column, interpolated between neighbours; None where it has no value."""
    n = df.where(f"`{value}` is not null and not isnan(cast(`{value}` as double))").count()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * q for q in shares]
    at = order_statistics(df, value, sorted({f(p) for p in places for f in (math.floor, math.ceil)}))
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


def iqr(df: DataFrame, value: str, reach: float = 1.5, name: str = "iqr") -> DataFrame:
    """Flag where value is so many quartile distances outside the quartiles (interpolated)."""
    a, b = quantiles(df, value, [0.25, 0.75])
    if a is None:
        return df.withColumn(name, F.lit(False))
    width = reach * (b - a)
    return df.withColumn(name, F.coalesce((F.col(value) < a - width) | (F.col(value) > b + width), F.lit(False)))


def density_noise(df: DataFrame, value: str, eps: float, least: int, name: str = "dbscan") -> DataFrame:
    """Flag the noise of a density clustering of one column.

    A value is a core if `least` rows, itself included, are within eps; noise is no core and has
    none within eps.  Works on the histogram of values, so equal values cost one row.
    """
    counts = df.groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).where("_v is not null and not isnan(_v)")
    cores = near_sums(storage.written(counts, "values"), "_n", eps).select("_v", (F.col("_near") >= least).cast("long").alias("_core"))
    noise = storage.written(near_sums(storage.written(cores, "cores"), "_core", eps).select("_v", (F.col("_near") == 0).alias("_noise")), "noise")
    return df.join(storage.small(noise), F.col(value).cast("double") == F.col("_v"), "left").withColumn(name, F.coalesce("_noise", F.lit(False))).drop("_v", "_noise")


def near_sums(values: DataFrame, measure: str, eps: float) -> DataFrame:
    """_v and _near, the sum of a whole-number measure over the rows of values (distinct _v) within eps of it.

    The sum up to a point is a running sum over all rows in order.  Each value asks for the sums just
    before _v - eps and up to _v + eps; values and questions are dealt out by ranges of a sample's
    quantiles, summed within each, and what lies before a range is added.  However densely values lie,
    a task gets its share of rows.
    """
    v, none = F.col("_v"), F.lit(0).cast("long")
    ask = [F.struct((v - eps).alias("x"), F.lit(0).alias("kind"), none.alias("n")), F.struct(v.alias("x"), F.lit(1).alias("kind"), F.col(measure).cast("long").alias("n")), F.struct((v + eps).alias("x"), F.lit(2).alias("kind"), none.alias("n"))]
    points = values.select("_v", F.explode(F.array(*ask)).alias("p")).select("_v", "p.*")
    dealt = storage.written(points.repartitionByRange("x", "kind").withColumn("_part", F.spark_partition_id()), "sweep")
    totals = dealt.groupBy("_part").agg(F.sum("n").alias("_sum"))  # a row for each range
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0))
    summed = dealt.withColumn("_upto", upto).where("kind <> 1").join(storage.small(totals.select("_part", before.alias("_before"))), "_part")
    return summed.groupBy("_v").agg(F.sum((F.col("_upto") + F.col("_before")) * (F.col("kind") - 1)).alias("_near"))


def _grown(sample: np.ndarray, rng: np.random.Generator, depth: int, most: int) -> list:
    spread = np.flatnonzero(sample.max(axis=0) > sample.min(axis=0)) if len(sample) > 1 else []
    if depth >= most or not len(spread):
        return [len(sample)]
    k = int(rng.choice(spread))
    at = float(rng.uniform(sample[:, k].min(), sample[:, k].max()))
    left = sample[:, k] < at
    return [k, at, _grown(sample[left], rng, depth + 1, most), _grown(sample[~left], rng, depth + 1, most)]


def _mean_path(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(tree: list, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + _mean_path(tree[0]))
    out, left = np.empty(len(x)), x[:, tree[0]] < tree[1]
    out[left], out[~left] = _depths(tree[2], x[left], depth + 1), _depths(tree[3], x[~left], depth + 1)
    return out


def isolation_forest(df: DataFrame, features: Sequence[str], share: float, trees: int = 100, sample: int = 256, seed: int = 42, name: str = "isolation", key: Sequence[str] = ()) -> DataFrame:
    """Flag about the given share of rows that random splits isolate soonest.

    The trees are grown on the driver from a sample of bounded size (trees * sample rows, the
    smallest hashes of key, features and seed, so that a rerun takes the same rows); every row is
    scored on the executors.  key names columns that tell rows of equal features apart.
    """
    doubles = [F.col(f).cast("double").alias(f) for f in features]
    keyed = df.select(*doubles, F.xxhash64(F.lit(seed), *key, *doubles).alias("_order")).dropna(subset=list(features))
    rows = keyed.orderBy("_order", *features).limit(trees * sample).drop("_order").toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(rows))
    forest = [_grown(rows[rng.choice(len(rows), size, replace=False)], rng, 0, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)] if size else []

    @F.pandas_udf("double")
    def isolation(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        depth = np.mean([_depths(t, np.nan_to_num(x)) for t in forest], axis=0) if forest else np.zeros(len(x))
        return pd.Series(2.0 ** (-depth / max(_mean_path(size), 1e-9)))

    scored = df.withColumn(f"{name}_score", isolation(*(F.col(f).cast("double") for f in features)))
    cut = scored.agg(F.percentile_approx(f"{name}_score", 1 - share, 10_000).alias("_cut"))
    return scored.join(F.broadcast(cut)).withColumn(name, F.col(f"{name}_score") > F.col("_cut")).drop("_cut")
