"""Daily revenue by branch: interpretable linear models against two baselines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import calendar
from millrace.operators import regression, star
from millrace.plans import schemas

_BRANCH = [f"branch_{b}" for b in sorted(schemas.BRANCHES)]
_WEEK = [f"dow_{d}" for d in star.DAYS[:4]]
_END = [f"dow_{d}" for d in star.DAYS[4:]]
FEATURES = {
    "M1": [*_BRANCH, *_WEEK, *_END, "is_holiday", "lag7_revenue_z", "trend_z"],
    "M2": [*_BRANCH, *_WEEK, *(f"weekend_{b}" for b in schemas.BRANCHES), *(f"holiday_{b}" for b in schemas.BRANCHES), "lag7_revenue_z", "trend_z"],
}
SCALED = ["lag7_revenue", "trend"]


def interactions(df: DataFrame) -> DataFrame:
    weekend = (F.col("day_of_week") >= 5).cast("int")
    return df.withColumns({f"{kind}_{b}": flag * F.col(f"branch_{b}") for b in schemas.BRANCHES for kind, flag in (("weekend", weekend), ("holiday", F.col("is_holiday")))})


_RAW = list(dict.fromkeys([c.removesuffix("_z") for m in FEATURES.values() for c in m]))
_PRODUCTS = [*_RAW, "_one", "revenue"]


@dataclass(frozen=True)
class Moments:
    """Cross products of unscaled features, a constant and revenue by month, and revenue by month, branch and weekday.

    Every fit on a set of months comes from sums of these: a scaled feature is a linear function of
    the unscaled one and the constant, so that its cross products follow from theirs.
    """

    products: dict[int, np.ndarray]
    means: dict[tuple[int, str, int], tuple[int, float]]

    def gram(self, before: int | None = None) -> np.ndarray:
        """Sums over the months before one, or over all."""
        size = len(_PRODUCTS)
        return sum((g for m, g in self.products.items() if before is None or m < before), np.zeros((size, size)))

    def scales(self, before: int | None = None) -> dict[str, tuple[float, float]]:
        """Mean and population deviation of the scaled columns."""
        g, one = self.gram(before), _PRODUCTS.index("_one")
        n, out = g[one, one], {}
        for c in SCALED:
            k = _PRODUCTS.index(c)
            mean = g[k, one] / n if n else 0.0
            out[c] = mean, float(np.sqrt(max(0.0, g[k, k] / n - mean * mean))) if n else 0.0
        return out

    def weights(self, model: str, before: int | None = None) -> np.ndarray:
        """Weights of a model's features, scaled on the months that it is fitted on."""
        g, scales, one = self.gram(before), self.scales(before), _PRODUCTS.index("_one")
        change = np.zeros((len(FEATURES[model]) + 1, len(_PRODUCTS)))
        for i, feature in enumerate(FEATURES[model]):
            c = feature.removesuffix("_z")
            mean, spread = scales.get(c, (0.0, 1.0))
            if spread > 0:
                change[i, _PRODUCTS.index(c)] = 1 / spread
                change[i, one] = -mean / spread
        change[-1, _PRODUCTS.index("revenue")] = 1
        scaled = change @ g @ change.T
        return np.linalg.lstsq(scaled[:-1, :-1], scaled[:-1, -1], rcond=None)[0]

    def predicted(self, model: str, before: int | None = None) -> Column:
        """The model's prediction over unscaled features (see interactions())."""
        scales, out = self.scales(before), F.lit(0.0)
        for feature, w in zip(FEATURES[model], self.weights(model, before)):
            c = feature.removesuffix("_z")
            mean, spread = scales.get(c, (0.0, 1.0))
            out = out + ((F.col(c) - mean) / spread if spread > 0 else F.lit(0.0)) * float(w)
        return out

    def usual(self, before: int) -> dict[tuple[str, int], float]:
        """Mean revenue by branch and weekday in the months before."""
        sums: dict[tuple[str, int], list[float]] = {}
        for (month, branch, day), (n, total) in self.means.items():
            if month < before:
                old = sums.get((branch, day), (0, 0.0))
                sums[branch, day] = old[0] + n, old[1] + total
        return {k: total / n for k, (n, total) in sums.items()}


def moments(df: DataFrame) -> Moments:
    """One scan; the driver gets a row for each month, branch and weekday."""
    doubles = interactions(df).select("month", "branch", "day_of_week", *(F.col(c).cast("double").alias(c) for c in [*_RAW, "revenue"])).dropna().withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(_PRODUCTS) for j, b in enumerate(_PRODUCTS) if i <= j]
    size, products, means = len(_PRODUCTS), {}, {}
    one, revenue = _PRODUCTS.index("_one"), _PRODUCTS.index("revenue")
    for r in doubles.groupBy("month", "branch", "day_of_week").agg(*sums).collect():
        g = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
        products[r["month"]] = products.get(r["month"], 0.0) + g
        means[r["month"], r["branch"], r["day_of_week"]] = int(g[one, one]), float(g[one, revenue])
    return Moments(products, means)


def predicted_months(df: DataFrame, found: Moments, months: Sequence[int]) -> DataFrame:
    """Rows of these months with the predictions B1 (last week), B2 (branch and weekday mean), M1 and M2, each from the months before its own."""
    rows = [(m, b, d, v) for m in months for (b, d), v in found.usual(m).items()]
    usual = F.broadcast(df.sparkSession.createDataFrame(rows, "month int, branch string, day_of_week int, B2 double"))  # weekdays x branches x months
    out = interactions(df.where(F.col("month").isin(*months))).join(usual, ["month", "branch", "day_of_week"], "left").withColumn("B1", F.col("lag7_revenue"))
    by_month = lambda model: F.coalesce(*(F.when(F.col("month") == m, found.predicted(model, m)) for m in months))
    return out.withColumns({m: by_month(m) for m in FEATURES})


def predict(train: DataFrame, test: DataFrame) -> tuple[DataFrame, Moments]:
    """test with the predictions of train: B1, B2, M1 and M2."""
    found = moments(train)
    rows = [(b, d, v) for (b, d), v in found.usual(1 << 30).items()]
    usual = F.broadcast(train.sparkSession.createDataFrame(rows, "branch string, day_of_week int, B2 double"))
    out = interactions(test).join(usual, ["branch", "day_of_week"], "left").withColumn("B1", F.col("lag7_revenue"))
    return out.withColumns({m: found.predicted(m) for m in FEATURES}), found


def scores(predicted: DataFrame, models: Sequence[str] = ("B1", "B2", "M1", "M2"), by: Sequence[str] = ()) -> DataFrame:
    long = predicted.where("B2 is not null").unpivot([*by, "date", "branch", "revenue"], list(models), "model", "predicted")
    return regression.metrics(long, "revenue", "predicted", [*by, "model"])


def _errors(df: DataFrame, found: Moments, months: Sequence[int]) -> list:
    """Scores of all models month by month; a row for each."""
    return scores(predicted_months(df, found, months), by=["month"]).collect()


def _best(errors: list, month: int) -> str:
    """Of M1 and M2 the one with the smaller error in a month, the first where they are equal."""
    return min((r["mae"], r["model"]) for r in errors if r["month"] == month and r["model"] in FEATURES)[1]


def select_model(df: DataFrame, validation: int = 5) -> str:
    """The model with the smaller error in the validation month, trained on the months before."""
    return _best(_errors(df, moments(df), [validation]), validation)


def _walked(df: DataFrame, errors: list, months: Sequence[int]) -> DataFrame:
    rows = [(*(r[c] for c in ("model", "mae", "mae_pct", "rmse", "r2", "bias")), m, chosen) for m in months for chosen in [_best(errors, m - 1)] for r in errors if r["month"] == m and r["model"] in ("B1", "B2", chosen)]
    return df.sparkSession.createDataFrame(rows, "model string, mae double, mae_pct double, rmse double, r2 double, bias double, month int, chosen string")


def walk_forward(df: DataFrame, months: Sequence[int] = (4, 5, 6)) -> DataFrame:
    """Errors month by month, each model being selected and trained on earlier months only.

    A month's model is the better one of the month before, for which it was trained on the months
    before that; so one scan for the cross products and one for the errors of all months do.
    """
    return _walked(df, _errors(df, moments(df), sorted({m - k for m in months for k in (0, 1)})), months)


def coefficients(df: DataFrame, model: str, found: Moments | None = None, before: int | None = None) -> DataFrame:
    """Weights of a model, for scaled features also by original unit."""
    found = found or moments(df)
    scales = found.scales(before)
    rows = []
    for f, w in zip(FEATURES[model], found.weights(model, before)):
        unit = f.removesuffix("_z") if f.endswith("_z") else None
        rows.append((f, float(w), float(w) / scales[unit][1] if unit and scales[unit][1] else None, unit))
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, per_original_unit double, original_unit string")


def residuals(predicted: DataFrame, model: str) -> dict[str, DataFrame]:
    error = F.col(model) - F.col("revenue")
    df = predicted.withColumns({"error": error, "week": calendar.week_of_month(F.col("date"))})
    return {
        "by_branch": df.groupBy("branch").agg(F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias")),
        "bias_by_week": df.groupBy("week").pivot("branch", list(schemas.BRANCHES)).agg(F.avg("error")),
        "worst_days": df.orderBy(F.desc(F.abs("error")), "date", "branch").limit(5).select("date", "branch", "revenue", model, "error"),
    }


def next_week(features: DataFrame, daily: DataFrame, model: str, days: int = 7, found: Moments | None = None) -> DataFrame:
    """Revenue of the days after the last one; a day without a lag has no prediction."""
    ends = daily.agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    future = ends.select("_first", F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", days))).alias("date")).join(star.fixed(daily.sparkSession, "branch", schemas.BRANCHES))
    lag = daily.select("branch", F.date_add("date", 7).alias("date"), F.col("revenue").alias("lag7_revenue"))
    dummies = {f"branch_{b}": (F.col("branch") == b).cast("int") for b in schemas.BRANCHES} | {f"dow_{d}": (F.weekday("date") == k + 1).cast("int") for k, d in enumerate(star.DAYS)}
    df = future.join(lag, ["branch", "date"], "left").withColumns({"trend": F.datediff("date", "_first"), "is_holiday": F.lit(0), "day_of_week": F.weekday("date")} | dummies)
    return interactions(df).select("date", "branch", "lag7_revenue", (found or moments(features)).predicted(model).alias("predicted_revenue"))


def tables(features: DataFrame, daily: DataFrame, test: int = 6) -> tuple[str, dict[str, DataFrame]]:
    """The chosen model, and the tables of a run: daily predictions of the test month, weights, the next week, errors month by month, residuals.

    Two scans, one for the cross products and one for the errors, give all fits and choices.
    """
    found, months = moments(features), [test - 2, test - 1, test]
    errors = _errors(features, found, [test - 3, *months])
    chosen = _best(errors, test - 1)
    predicted = predicted_months(features, found, [test])
    named = predicted.select("branch", "date", F.col("revenue").alias("actual_revenue"), "B1", "B2", *FEATURES, F.lit(chosen).alias("chosen_model"))
    out = {
        "forecast_daily": named, "forecast_coefficients": coefficients(features, chosen, found, test), "forecast_next_week": next_week(features, daily, chosen, found=found),
        "forecast_walk_forward": _walked(features, errors, months),
    }
    return chosen, out | {f"forecast_residuals_{k}": df for k, df in residuals(predicted, chosen).items()}
