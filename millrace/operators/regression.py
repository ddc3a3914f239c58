"""Least squares on a table of any size: one aggregate of cross products, solved on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fit:
    features: tuple[str, ...]
    weights: np.ndarray
    intercept: float
    rows: int
    #: Sample deviation of residuals, with a degree of freedom for each parameter.
    residual_sd: float

    def predicted(self) -> Column:
        return sum((F.col(f) * float(w) for f, w in zip(self.features, self.weights)), F.lit(float(self.intercept)))

    def coefficients(self) -> list[tuple[str, float]]:
        return [*zip(self.features, map(float, self.weights)), ("intercept", float(self.intercept))]


def least_squares(df: DataFrame, features: Sequence[str], target: str, intercept: bool = True) -> Fit:
    """Fit on the rows without nulls.  A singular design gives the smallest weights that fit best."""
    names = [*features, *(["_one"] if intercept else []), target]
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in [*features, target]), *([F.lit(1.0).alias("_one")] if intercept else [])).dropna()
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)).first()
    k = len(names) - 1
    gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
    weights = np.linalg.lstsq(gram[:k, :k], gram[:k, k], rcond=None)[0]
    squares = max(0.0, gram[k, k] - 2 * weights @ gram[:k, k] + weights @ gram[:k, :k] @ weights)
    freedom = max(1, (sums["n"] or 0) - k)
    return Fit(tuple(features), weights[: len(features)], float(weights[-1]) if intercept else 0.0, sums["n"] or 0, float(np.sqrt(squares / freedom)))


def metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MAE in percent, RMSE, R2 and bias; fails where a value is null."""
    a, error = F.col(actual), F.col(predicted) - F.col(actual)
    unknown = F.count_if(error.isNull()) > 0
    mae = F.when(unknown, F.raise_error(F.lit("metrics need values without nulls"))).otherwise(F.avg(F.abs(error)))
    return df.groupBy(*by).agg(
        mae.alias("mae"), (F.avg(F.abs(error)) / F.avg(a) * 100).alias("mae_pct"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(a) * F.count(a))).alias("r2"), F.avg(error).alias("bias"),
    )
