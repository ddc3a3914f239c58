"""Filling unknown birth years from what members buy; methods are compared on held-out members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import values
from millrace.operators import regression
from millrace.plans import schemas

HOLDOUT = 5
BEHAVIOUR = ("n_bills", "share_cmu", "avg_hour", "share_weekend", "avg_bill_value", "share_non_coffee")


def member_features(members: DataFrame, sales: DataFrame, products: DataFrame, branches=schemas.BRANCHES) -> DataFrame:
    """Behaviour of each member from lines to bills to members; home branch as dummies."""
    lines = sales.where("member_id is not null").join(F.broadcast(products.select("product_id", "category")), "product_id", "left")
    first = lambda c: F.min_by(c, "row_id")
    bills = lines.groupBy("member_id", "receipt_id").agg(
        first(F.col("branch") == "cmu").alias("cmu"), first(F.hour("sale_datetime")).alias("hour"), first(F.weekday("sale_datetime") >= 5).alias("weekend"),
        F.sum("line_total").alias("value"), F.avg(values.holds(F.col("category") == "non_coffee").cast("double")).alias("non_coffee"),
    )
    share = lambda c: F.avg(F.col(c).cast("double"))
    behaviour = bills.groupBy("member_id").agg(F.count(F.lit(1)).alias("n_bills"), share("cmu").alias("share_cmu"), F.avg("hour").alias("avg_hour"), share("weekend").alias("share_weekend"), F.avg("value").alias("avg_bill_value"), F.avg("non_coffee").alias("share_non_coffee"))
    home = [values.holds(F.col("home_branch") == b).cast("double").alias(f"home_{b}") for b in sorted(branches)[1:]]
    return members.select("member_id", "birth_year", *home).join(behaviour, "member_id", "left").na.fill(0, list(BEHAVIOUR))


def features(branches=schemas.BRANCHES) -> list[str]:
    return [*(f"home_{b}" for b in sorted(branches)[1:]), *BEHAVIOUR]


def _noise(sd: float, seed: int):
    """Normal noise from the member's hash, so that a rerun gives the same."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "member_id"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    return sd * F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * 3.141592653589793 * unit(1))


def compare(rows: DataFrame, seed: int = 42) -> tuple[DataFrame, str]:
    """MAE and spread of each method on a fifth of the members with a known year; the best method."""
    known = rows.where("birth_year is not null").withColumn("_test", F.pmod(F.xxhash64(F.lit(seed), "member_id"), F.lit(HOLDOUT)) == 0)
    train = known.where("not _test")
    fit = regression.least_squares(train, features(), "birth_year")
    stats = train.agg(F.avg("birth_year").alias("mean"), F.median("birth_year").alias("median")).first()
    ways = {"mean": F.lit(stats["mean"] or 0.0), "median": F.lit(float(stats["median"] or 0)), "regression": fit.predicted(), "stochastic_regression": fit.predicted() + _noise(fit.residual_sd, seed)}
    after = [F.stddev_pop(F.when(F.col("_test"), F.col(w)).otherwise(F.col("birth_year"))).alias(f"std_{w}") for w in ways]
    row = known.withColumns(ways).agg(*(F.avg(F.when(F.col("_test"), F.abs(F.col(w) - F.col("birth_year")))).alias(f"mae_{w}") for w in ways), *after, F.stddev_pop(F.when(~F.col("_test"), F.col("birth_year"))).alias("std_listwise")).first()
    table = [("listwise_deletion", None, row["std_listwise"]), *((w, row[f"mae_{w}"], row[f"std_{w}"]) for w in ways)]
    best = min((t for t in table if t[1] is not None), key=lambda t: t[1], default=("mean",))[0]
    spark = rows.sparkSession
    return spark.createDataFrame([(*t, t[0] == best) for t in table], "method string, mae_years double, std_after double, chosen boolean"), best


def impute(members: DataFrame, sales: DataFrame, products: DataFrame, year: int = 2026, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """members with birth_year filled and birth_year_imputed, and the comparison of methods."""
    rows = member_features(members, sales, products)
    table, best = compare(rows, seed)
    known = rows.where("birth_year is not null")
    if best in ("mean", "median"):
        fill = F.lit(float(known.agg(F.avg("birth_year") if best == "mean" else F.median("birth_year")).first()[0] or year - 30))
    else:
        fit = regression.least_squares(known, features(), "birth_year")
        fill = fit.predicted() + (_noise(fit.residual_sd, seed) if best == "stochastic_regression" else F.lit(0.0))
    low, high = year - schemas.AGES[1], year - schemas.AGES[0]
    filled = rows.select("member_id", values.within(values.half_even(fill), low, high).cast("int").alias("_fill"))
    out = members.join(filled.dropDuplicates(["member_id"]), "member_id", "left").withColumn("birth_year_imputed", F.col("birth_year").isNull())
    return out.withColumn("birth_year", F.coalesce("birth_year", "_fill")).drop("_fill"), table
