"""Cleaning and rules held against what a generator of test data says is true.

Clean lines have no line number.  They are aligned with the true ones as multisets: within a receipt
and product, the first clean line meets the first true one, the second the second, so that repeats
match one to one and what is left over counts as lost or strange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Faults whose lines have to go.
REMOVED = ("B10", "C1")
#: Mistyped quantities and real large orders.
TYPOS, LARGE = "C1", "C3"
#: Repairs: the flag and the column that must be true after it.
REPAIRS = {"product_synonym": "product_id", "size_from_price": "size", "qty_from_total": "qty", "price_from_list": "unit_price", "price_fixed_from_list": "unit_price", "member_id_fixed": "member_id", "member_id_merged": "member_id"}
KEY = ["receipt_id", "product_id", "nth"]


def numbered(lines: DataFrame, order: str) -> DataFrame:
    """lines with `nth`, their number within receipt and product."""
    return lines.withColumn("nth", F.row_number().over(Window.partitionBy("receipt_id", "product_id").orderBy(order)))


def aligned(sales: DataFrame, truth: DataFrame, issues: DataFrame) -> DataFrame:
    """A row for each pair of a clean and a true line, or one of them alone: structs `clean` and `true`, and the line's issues."""
    put_in = issues.groupBy("receipt_id", "line_no").agg(F.collect_set("issue_id").alias("issues"))
    true = numbered(truth, "line_no").join(put_in, ["receipt_id", "line_no"], "left").select(*KEY, F.struct("*").alias("true"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))
    clean = numbered(sales, "row_id").select(*KEY, F.struct("*").alias("clean"))
    return clean.join(true, KEY, "full").withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))


def rows(pairs: DataFrame) -> DataFrame:
    """One row: true and clean lines, those that had to go, that went, rightly and wrongly, and strange ones."""
    lost, due = F.col("clean").isNull(), F.arrays_overlap("issues", F.array(*map(F.lit, REMOVED)))
    there = F.col("true").isNotNull()
    return pairs.agg(
        F.count_if(there).alias("true_lines"), F.count_if(F.col("clean").isNotNull()).alias("clean_lines"), F.count_if(there & due).alias("due"), F.count_if(there & lost).alias("removed"),
        F.count_if(there & lost & due).alias("removed_rightly"), F.count_if(there & lost & ~due).alias("removed_wrongly"), F.count_if(~there).alias("strange"),
    )


def by_issue(pairs: DataFrame) -> DataFrame:
    """issue_id, lines, removed, kept_true: of the lines with a fault, those removed and those whose values are all true now."""
    true = F.lit(True)
    for c, t in (("size", "size"), ("qty", "qty"), ("unit_price", "unit_price")):
        true = true & F.col(f"clean.{c}").eqNullSafe(F.col(f"true.{t}"))
    each = pairs.where("true is not null").select(F.explode("issues").alias("issue_id"), F.col("clean").isNull().alias("gone"), true.alias("right"))
    return each.groupBy("issue_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("gone").alias("removed"), F.count_if(~F.col("gone") & F.col("right")).alias("kept_true"))


def repairs(pairs: DataFrame) -> DataFrame:
    """repair, rows, correct, accuracy for each kind of repair, in one pass."""
    met = pairs.where("clean is not null and true is not null")
    has = lambda f: F.array_contains("clean.clean_flags", f)
    right = lambda c: F.col(f"clean.{c}").eqNullSafe(F.col(f"true.{c}"))
    counts = met.agg(*(F.count_if(x).alias(f"{f}_{k}") for f, c in REPAIRS.items() for k, x in (("n", has(f)), ("ok", has(f) & right(c)))))
    entry = [F.struct(F.lit(f).alias("repair"), F.col(f"{f}_n").alias("rows"), F.col(f"{f}_ok").alias("correct"), F.try_divide(f"{f}_ok", f"{f}_n").alias("accuracy")) for f in REPAIRS]
    return counts.select(F.explode(F.array(*entry)).alias("e")).select("e.*")


def mismatches(pairs: DataFrame) -> DataFrame:
    """column, rows: clean values that are not the true ones; times only where they are not marked, members only where not dropped as unknown."""
    met = pairs.where("clean is not null and true is not null")
    off = {c: ~F.col(f"clean.{c}").eqNullSafe(F.col(f"true.{c}")) for c in ("size", "qty", "unit_price", "payment")}
    off["sale_datetime"] = ~F.col("clean.sale_datetime").eqNullSafe(F.col("true.sale_dt")) & ~F.col("clean.time_suspect")
    off["member_id"] = ~F.col("clean.member_id").eqNullSafe(F.col("true.member_id")) & ~F.array_contains("clean.clean_flags", "member_id_unknown")
    return met.agg(*(F.count_if(x).alias(c) for c, x in off.items())).unpivot([], list(off), "column", "rows")


def detectors(flags: DataFrame, staging: DataFrame, truth: DataFrame, issues: DataFrame) -> DataFrame:
    """For each outlier method: mistyped quantities found, lines of real large orders flagged, other lines flagged."""
    typos = issues.where(F.col("issue_id") == TYPOS).join(truth, ["receipt_id", "line_no"]).select("receipt_id", "product_id").distinct().withColumn("typo", F.lit(True))
    large = issues.where(F.col("issue_id") == LARGE).select("receipt_id").distinct().withColumn("large", F.lit(True))
    lines = flags.join(staging.select("row_id", "receipt_id", "product_id"), "row_id").join(typos, ["receipt_id", "product_id"], "left").join(large, "receipt_id", "left").na.fill(False, ["typo", "large"])
    long = lines.unpivot(["typo", "large"], ["zscore", "iqr", "dbscan", "isolation"], "method", "flag").where("flag")
    return long.groupBy("method").agg(F.count_if("typo").alias("typos"), F.count_if(~F.col("typo") & F.col("large")).alias("large_orders"), F.count_if(~F.col("typo") & ~F.col("large")).alias("others"))


def members(clean: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: members, known birth years and genders that are true, and the mean error of imputed birth years."""
    met = clean.join(truth.select("member_id", F.col("birth_year").alias("_year"), F.col("gender").alias("_gender")), "member_id")
    given, known = ~F.col("birth_year_imputed"), F.col("gender") != "U"
    return met.agg(
        F.count(F.lit(1)).alias("members"), F.count_if(given).alias("given_years"), F.count_if(given & (F.col("birth_year") == F.col("_year"))).alias("given_years_true"),
        F.avg(F.when(~given, F.abs(F.col("birth_year") - F.col("_year")))).alias("imputed_error"), F.count_if(known).alias("genders"), F.count_if(known & (F.col("gender") == F.col("_gender"))).alias("genders_true"),
    )


def rules(mined: DataFrame, planted: list[tuple[str, str]]) -> DataFrame:
    """One row: planted pairs either way round, passing rules, those found, strange ones, missed ones."""
    both = mined.sparkSession.createDataFrame(sorted({p for a, b in planted for p in ((a, b), (b, a))}), "antecedent string, consequent string").withColumn("planted", F.lit(True))
    met = mined.where("passes").select("antecedent", "consequent", "passes").join(both, ["antecedent", "consequent"], "full").na.fill(False, ["passes", "planted"])
    return met.agg(F.count_if("planted").alias("planted"), F.count_if("passes").alias("rules"), F.count_if(F.col("planted") & F.col("passes")).alias("found"), F.count_if(~F.col("planted")).alias("strange"), F.count_if(~F.col("passes")).alias("missed"))
