"""From the shops' files to one staging table: schema mapping, translation, flags, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import calendar, values
from millrace.operators import storage
from millrace.plans import schemas


def _finished(df: DataFrame, branch: str, products: DataFrame, source_file: str) -> DataFrame:
    key = schemas.PRODUCT_KEYS[branch]
    names = products.where(F.col(key).isNotNull()).select(F.col(key).alias("product_raw"), "product_id")
    out = df.join(storage.small(names), "product_raw", "left").withColumns({
        "branch": F.lit(branch), "source_file": F.lit(source_file),
        "size": values.translated(F.col("size_raw"), schemas.SIZES[branch]), "payment": values.translated(F.col("payment_raw"), schemas.PAYMENTS[branch]),
    })
    lost = lambda raw, found: F.col(raw).isNotNull() & F.col(found).isNull()
    flags = values.flags({
        "datetime_unparsed": lost("datetime_raw", "sale_datetime"), "product_unmatched": lost("product_raw", "product_id"),
        "size_unmapped": lost("size_raw", "size"), "payment_unmapped": lost("payment_raw", "payment"),
    })
    return out.withColumn("extract_flags", flags).select(*schemas.STAGING)


def standardize_nimman(raw: DataFrame, products: DataFrame, source_file: str = "nimman_sales.csv") -> DataFrame:
    df = raw.withColumnsRenamed(schemas.NIMMAN_COLUMNS)
    df = df.withColumns({"qty": values.number(F.col("qty")), "unit_price": values.number(F.col("unit_price")), "sale_datetime": calendar.buddhist_datetime(F.col("datetime_raw"))})
    df = df.withColumns({"line_total": F.col("qty") * F.col("unit_price"), "price_source": F.when(F.col("unit_price").isNotNull(), "file")})
    return _finished(df, "nimman", products, source_file)


def standardize_cmu(raw: DataFrame, products: DataFrame, source_file: str = "cmu_sales.xlsx") -> DataFrame:
    date, time = F.col(schemas.CMU_DATE), F.col(schemas.CMU_TIME)
    df = raw.withColumnsRenamed(schemas.CMU_COLUMNS).withColumns({"datetime_raw": F.concat_ws(" ", F.substring(date, 1, 10), time), "sale_datetime": calendar.date_and_time(date, time)})
    df = df.withColumns({"qty": values.number(F.col("qty")), "line_total": values.number(F.col("line_total"))})
    df = df.withColumn("unit_price", F.when(F.col("qty") != 0, F.col("line_total") / F.col("qty")))
    return _finished(df.withColumn("price_source", F.when(F.col("unit_price").isNotNull(), "derived_from_total")), "cmu", products, source_file)


def standardize_thaphae(raw: DataFrame, products: DataFrame, source_file: str = "thaphae_sales.json") -> DataFrame:
    df = raw.withColumns({"qty": values.number(F.col("qty")), "unit_price": values.number(F.col("unit_price")), "sale_datetime": calendar.utc_timestamp(F.col("datetime_raw"))})
    df = df.withColumns({"line_total": F.col("qty") * F.col("unit_price"), "price_source": F.when(F.col("unit_price").isNotNull(), "file")})
    return _finished(df, "thaphae", products, source_file)


def integrate(parts: dict[str, DataFrame]) -> DataFrame:
    """All branches in one table, with row_id for a stable order of rows."""
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part)
    return out.withColumn("row_id", F.monotonically_increasing_id())


def reconcile(staging: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Counts for each branch and in total; raises ValueError if rows were lost or added."""
    found = storage.written(report(staging), "reconciled")
    counts = {r["branch"]: r for r in found.collect()}  # a row for each branch
    every = reduce(DataFrame.unionByName, (part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(branch).alias("branch"), "n") for branch, part in parts.items()))
    for branch, expected in every.collect():  # a row for each part
        if expected != (counts[branch]["rows"] if branch in counts else 0):
            raise ValueError(f"{branch}: {expected} rows read, {counts[branch]['rows'] if branch in counts else 0} in staging")
    return found


def report(staging: DataFrame) -> DataFrame:
    """Rows, missing values and flags for each branch, with a total; staging is evaluated once, and written as a row for each branch.

    A receipt counts in the total with the first of its branches.
    """
    names = ("datetime_unparsed", "product_unmatched", "size_unmapped", "payment_unmapped")
    bills = staging.groupBy("receipt_id", "branch").agg(F.count(F.lit(1)).alias("rows"), F.sum("line_total").alias("revenue"), *(F.count_if(F.array_contains("extract_flags", n)).alias(n) for n in names))
    first = F.col("receipt_id").isNotNull() & (F.row_number().over(Window.partitionBy("receipt_id").orderBy("branch")) == 1)
    sums = [F.sum("revenue").alias("revenue"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)]
    rows = F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")
    by_branch = storage.written(bills.withColumn("_first", first).groupBy("branch").agg(rows, F.count("receipt_id").alias("receipts"), *sums, F.count_if("_first").alias("_first")), "branches")
    total = by_branch.agg(rows, F.coalesce(F.sum("_first"), F.lit(0)).alias("receipts"), *sums).withColumn("branch", F.lit("total"))
    return by_branch.drop("_first").unionByName(total)


def as_text(df: DataFrame) -> DataFrame:
    """Flags joined with semicolons, for files."""
    return df.withColumns({c: F.array_join(c, ";") for c, kind in df.dtypes if kind == "array<string>"})
