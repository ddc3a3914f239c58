"""Scans of the retail files.  Everything is read as text first, by declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans import schemas
from millrace.sources import nested, xlsx


def _numbered(df: DataFrame) -> DataFrame:
    """source_row: the line in its file, the header being line 1, by place and not by count.

    Each file's rows are counted by partition of the scan first, so that no task sees a whole file.
    """
    placed = df.withColumns({"_file": F.input_file_name(), "_id": F.monotonically_increasing_id()})
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    first = placed.groupBy("_file", "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row for each split
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = first.select("_file", "_part", "_first", before.alias("_before"))
    row = F.col("_id") - F.col("_first") + F.col("_before") + 2
    return placed.join(F.broadcast(starts), ["_file", "_part"]).withColumn("source_row", row.cast("string")).drop("_file", "_id", "_part", "_first", "_before")


def read_nimman(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: one line for each item sold."""
    schema = ", ".join(f"{c} string" for c in schemas.NIMMAN_COLUMNS)
    return _numbered(spark.read.schema(schema).option("header", True).csv(path))


def read_cmu(spark: SparkSession, path: str) -> DataFrame:
    """XLSX with Thai headers; cells as text, with their line in the sheet."""
    return xlsx.read_sheets(spark, path, [*schemas.CMU_COLUMNS, schemas.CMU_DATE, schemas.CMU_TIME])


def read_receipts(spark: SparkSession, path: str) -> nested.Document:
    """The receipts of JSON documents, and the documents' own fields."""
    return nested.read_elements(spark, path, "receipts")


def bills(found: nested.Document) -> DataFrame:
    """file, place and bill, as it is nested, of each receipt."""
    return found.elements.select("file", "place", F.from_json("text", schemas.RECEIPT).alias("bill"))


def flat_receipts(found: nested.Document) -> DataFrame:
    """A row for each item, with the place of its receipt and item as source_row."""
    items = bills(found).select("place", "bill", F.posexplode("bill.items").alias("i", "item"))
    return items.select(
        F.col("bill.receipt_id").alias("receipt_id"), F.col("bill.timestamp").alias("datetime_raw"), F.col("item.sku").alias("product_raw"), F.col("item.size").alias("size_raw"),
        F.col("item.quantity").alias("qty"), F.col("item.price").alias("unit_price"), F.col("bill.customer.member_id").alias("member_id"), F.col("bill.payment.method").alias("payment_raw"),
        F.format_string("receipts[%d].items[%d]", "place", "i").alias("source_row"),
    )


def receipts_metadata(found: nested.Document) -> DataFrame:
    """branch, exported_at and n_receipts of each file."""
    counts = found.elements.groupBy("file").agg(F.count(F.lit(1)).alias("n_receipts"))
    fields = found.outer.select("file", F.from_json("text", "branch string, exported_at string").alias("meta"))
    return fields.join(counts, "file", "left").select("meta.branch", "meta.exported_at", F.coalesce("n_receipts", F.lit(0)).alias("n_receipts"))


def read_members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MEMBERS).option("header", True).csv(path)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PRODUCTS).option("header", True).csv(path)


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HOLIDAYS).option("header", True).csv(path)


def read_truth(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a generator says is true: sales lines, members, and the faults put in (issue_id, receipt_id, line_no)."""
    sales = spark.read.option("header", True).csv(f"{folder}/sales_truth.csv")
    sales = sales.withColumns({"line_no": F.col("line_no").cast("int"), "qty": F.col("qty").cast("double"), "unit_price": F.col("unit_price").cast("double"), "sale_dt": F.to_timestamp("sale_dt")})
    members = spark.read.option("header", True).csv(f"{folder}/members_truth.csv").withColumn("birth_year", F.col("birth_year").cast("int"))
    issue = "issue_id: string, receipt_id: string, line_no: int"
    listed = spark.read.schema(f"issues array<struct<{issue}>>").option("multiLine", True).json(f"{folder}/injected_issues.json")
    return sales, members, listed.select(F.explode("issues").alias("i")).select("i.*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
