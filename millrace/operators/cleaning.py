"""Repairs of members and sales, each an auditable step from DataFrame to DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text, values
from millrace.operators import outliers, rules, storage, windows
from millrace.plans import schemas


@dataclass(frozen=True)
class Entry:
    """A line of the cleaning log: rows of a table (sales, removed, members or merged) where a condition holds."""

    step: str
    table: str
    name: str
    rule: str
    problem: str
    technique: str
    action: str
    chapter: str
    source: str
    condition: Column


LOG = "step string, `table` string, name string, quality_rule string, problem string, technique string, action string, rows long, chapter string"


def entries() -> list[Entry]:
    """What is logged.  Counts are taken while the tables are written, see Cleaned.written()."""
    flag = lambda f: F.array_contains("clean_flags", f)
    note = lambda f: F.array_contains("_notes", f)
    reason = lambda r: F.col("removed_reason") == r
    every = F.lit(True)
    return [
        Entry("M1", "members", "name_spaces", "", "superfluous spaces in names", "standard form", "fixed", "Ch4", "members", note("name_spaces")),
        Entry("M1", "members", "phone_form", "CS3", "phone numbers in several forms", "standard form", "fixed", "Ch3", "members", note("phone_form")),
        Entry("M2", "members", "merged", "UQ4", "members registered twice", "one row for a name and phone", "merged", "Ch3", "merged", every),
        Entry("M3", "members", "birth_year_be", "VL4", "birth year of the Buddhist era", "validity rule", "fixed", "Ch3", "members", note("birth_year_be")),
        Entry("M3", "members", "birth_year_impossible", "VL4", "impossible birth year", "validity rule", "emptied", "Ch3", "members", note("birth_year_impossible")),
        Entry("M4", "members", "gender unknown", "CP5", "no gender", "a group of its own", "flagged", "Ch4", "members", F.col("gender") == schemas.GENDER_UNKNOWN),
        Entry("S1", "sales", "duplicate", "UQ1, UQ2", "repeated lines and bills", "first of equal rows", "removed", "Ch3", "removed", reason("duplicate")),
        Entry("S2", "sales", "product_synonym", "CS1", "product under another name", "normal form and synonyms", "fixed", "Ch2", "sales", flag("product_synonym")),
        Entry("S2", "sales", "unknown_product", "CS1", "product cannot be told", "listwise deletion", "removed", "Ch4", "removed", reason("unknown_product")),
        Entry("S3", "sales", "member_id_fixed", "CS2", "letter O in member ids", "pattern and member list", "fixed", "Ch3", "sales", flag("member_id_fixed")),
        Entry("S3", "sales", "member_id_unknown", "CS2", "member does not exist", "consistency of tables", "emptied", "Ch3", "sales", flag("member_id_unknown")),
        Entry("S3", "sales", "member_id_merged", "UQ4", "id of a merged member", "id of the first registration", "fixed", "Ch3", "sales", flag("member_id_merged")),
        Entry("S4", "sales", "non_positive_qty", "VL1", "quantity not above 0", "validity rule", "removed", "Ch3", "removed", reason("non_positive_qty")),
        Entry("S4", "sales", "time_suspect", "VL2", "time outside of opening hours", "validity rule", "flagged", "Ch3", "sales", flag("time_suspect")),
        Entry("S5", "sales", "price_fixed_from_list", "AC1", "price not that of the list", "reference values", "fixed", "Ch3", "sales", flag("price_fixed_from_list")),
        Entry("S5", "sales", "qty_over_limit_review", "", "large quantity that is no outlier", "business limit", "flagged", "Ch4", "sales", flag("qty_over_limit_review")),
        Entry("S5", "sales", "qty_typo", "", "mistyped quantity", "z-score beyond the business limit", "removed", "Ch4", "removed", reason("qty_typo")),
        Entry("S5", "sales", "large_order_kept", "", "large order", "z-score within the business limit", "flagged", "Ch4", "sales", flag("large_order_kept")),
        Entry("S6", "sales", "size_from_price", "CP4", "no size", "size that has the price", "filled", "Ch2", "sales", flag("size_from_price")),
        Entry("S6", "sales", "size_mode", "CP4", "no size and no price", "most frequent size of the product", "estimated", "Ch4", "sales", flag("size_mode")),
        Entry("S6", "sales", "qty_from_total", "CP3", "no quantity", "total by list price", "filled", "Ch2", "sales", flag("qty_from_total")),
        Entry("S6", "sales", "price_from_list", "CP2", "no unit price", "list price", "filled", "Ch2", "sales", flag("price_from_list")),
        Entry("S6", "sales", "cannot_fill", "", "no value to be had", "listwise deletion", "removed", "Ch4", "removed", reason("cannot_fill")),
        Entry("S7", "sales", "line_total", "", "total is not quantity by price", "computed again", "fixed", "Ch2", "sales", F.col("_changed")),
    ]


# Members


def standardize_members(members: DataFrame) -> DataFrame:
    return members.withColumns({"full_name": text.collapse_space(F.col("full_name")), "phone": text.standard_phone(F.col("phone"))})


def merge_members(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each name and phone, the earliest, with the group's first known values; and (dup_id, master_id)."""
    keys, order = ["full_name", "phone"], [F.col("register_date").asc_nulls_last(), F.col("member_id").asc_nulls_last()]
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = members.withColumns({"_rank": F.row_number().over(Window.partitionBy(*keys).orderBy(*order)), "_master": F.first("member_id").over(whole), "gender": windows.first_filled("gender", keys, order), "birth_year": windows.first_filled("birth_year", keys, order)})
    merged = filled.where("_rank = 1").drop("_rank", "_master")
    return merged, filled.where("_rank > 1").select(F.col("member_id").alias("dup_id"), F.col("_master").alias("master_id"), *(c for c in ("_notes",) if c in members.columns))


def fix_birth_year(members: DataFrame, year: int) -> DataFrame:
    """Impossible years: of the Buddhist era if that gives a possible age, else unknown."""
    ok = lambda y: values.holds((year - y).between(*schemas.AGES))
    y = F.col("birth_year")
    return members.withColumn("birth_year", F.when(ok(y), y).when(ok(y - 543), y - 543))


def fill_gender(members: DataFrame) -> DataFrame:
    return members.withColumn("gender", F.coalesce("gender", F.lit(schemas.GENDER_UNKNOWN)))


# Sales


def remove_duplicates(sales: DataFrame) -> tuple[DataFrame, DataFrame]:
    core = [c for c in sales.columns if c not in ("source_row", "row_id")]
    marked = windows.mark_repeats(sales, core, ["row_id"])
    return marked.where("not repeat").drop("repeat"), marked.where("repeat").drop("repeat")


def synonyms(products: DataFrame) -> DataFrame:
    """(form, synonym_id): normal forms of names and codes that stand for one product only."""
    names = products.select("product_id", F.explode(F.array("name_th", "name_en", "nimman_code", "thaphae_sku")).alias("name")).where("name is not null")
    forms = names.select(text.normal_form(F.col("name")).alias("form"), "product_id").distinct()
    return forms.groupBy("form").agg(F.min("product_id").alias("synonym_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def fix_products(sales: DataFrame, products: DataFrame) -> DataFrame:
    found = sales.withColumn("form", text.normal_form(F.col("product_raw"))).join(storage.small(synonyms(products)), "form", "left").drop("form")
    new = F.col("product_id").isNull() & F.col("synonym_id").isNotNull()
    return found.withColumns({"clean_flags": values.flagged("clean_flags", new, "product_synonym"), "product_id": F.coalesce("product_id", "synonym_id")}).drop("synonym_id")


def fix_members(sales: DataFrame, members: DataFrame, id_map: DataFrame) -> DataFrame:
    """Ids with a letter O repaired, unknown ids dropped, duplicates' ids replaced by the master's."""
    ids = members.select(F.col("member_id").alias("_known")).union(id_map.select("dup_id")).distinct()
    ids = storage.small(storage.written(ids.join(id_map, F.col("_known") == F.col("dup_id"), "left"), "ids"))  # each duplicate's id is known
    fixed = F.when(F.col("member_id").rlike("^MO[0-9]{3}$"), text.repaired_id(F.col("member_id"))).otherwise(F.col("member_id"))
    found = sales.withColumn("_fixed", fixed).join(ids, F.col("_fixed") == F.col("_known"), "left")
    given = F.col("member_id").isNotNull()
    unknown = given & F.col("_known").isNull()
    repaired = given & F.col("_known").isNotNull() & (F.col("_fixed") != F.col("member_id"))
    found = found.withColumns({"_f1": repaired, "_f2": unknown, "_f3": F.col("master_id").isNotNull()})
    for name, flag in (("_f1", "member_id_fixed"), ("_f2", "member_id_unknown"), ("_f3", "member_id_merged")):
        found = found.withColumn("clean_flags", values.flagged("clean_flags", F.col(name), flag))
    return found.withColumn("member_id", F.when(~F.col("_f2"), F.coalesce("master_id", "_fixed"))).drop("_fixed", "_known", "dup_id", "master_id", "_f1", "_f2", "_f3")


def split(sales: DataFrame, remove) -> tuple[DataFrame, DataFrame]:
    """The rows to keep and those where the condition holds."""
    marked = sales.withColumn("_out", values.holds(remove))
    return marked.where("not _out").drop("_out"), marked.where("_out").drop("_out")


def mark_times(sales: DataFrame) -> DataFrame:
    hour = F.hour("sale_datetime")
    suspect = values.holds((hour < schemas.OPEN_HOUR) | (hour >= schemas.CLOSE_HOUR))
    return sales.withColumns({"time_suspect": suspect, "clean_flags": values.flagged("clean_flags", suspect, "time_suspect")})


def fix_prices(sales: DataFrame, products: DataFrame) -> DataFrame:
    listed = rules.with_products(sales, products)
    wrong = F.abs(F.col("unit_price") - F.col("list_price")) > schemas.PRICE_TOLERANCE
    return listed.withColumns({"clean_flags": values.flagged("clean_flags", wrong, "price_fixed_from_list"), "unit_price": F.when(values.holds(wrong), F.col("list_price")).otherwise(F.col("unit_price"))}).select(*sales.columns)


def outlier_features(sales: DataFrame, products: DataFrame) -> DataFrame:
    """qty, value, items in the bill and hour of rows with a quantity, for the detectors."""
    listed = rules.with_products(sales.where("qty is not null"), products)
    bill = Window.partitionBy("receipt_id")
    price = F.coalesce("unit_price", "list_price", F.col("price_M").cast("double"), F.lit(0.0))
    return listed.select("row_id", "qty", (F.col("qty") * price).alias("value"), F.count(F.lit(1)).over(bill).alias("items_in_bill"), F.coalesce(F.hour("sale_datetime"), F.lit(0)).alias("hour"))


def detect_outliers(features: DataFrame, eps: float = 3, least: int = 10, share: float = 0.005) -> DataFrame:
    found = outliers.density_noise(outliers.iqr(outliers.zscore(features, "qty"), "qty"), "qty", eps, least)
    return outliers.isolation_forest(found, ["qty", "value", "items_in_bill", "hour"], share, key=["row_id"])


def summarize_outliers(flags: DataFrame, limit: int = schemas.LARGE_QTY) -> DataFrame:
    """For each method the flagged rows, those beyond the limit and those within."""
    long = flags.unpivot(["row_id", "qty"], ["zscore", "iqr", "dbscan", "isolation"], "method", "flag")
    return long.groupBy("method").agg(F.count_if("flag").alias("flagged"), F.count_if(F.col("flag") & (F.col("qty") > limit)).alias("over_limit"), F.count_if(F.col("flag") & (F.col("qty") <= limit)).alias("within_limit"))


def judge_quantities(sales: DataFrame, limit: int = schemas.LARGE_QTY) -> tuple[DataFrame, DataFrame]:
    """Outliers beyond the limit are typing errors; within it they are large orders."""
    found = outliers.zscore(sales, "qty", name="_z")
    large = F.col("qty") > limit
    kept, removed = split(found, F.col("_z") & large)
    kept = kept.withColumn("clean_flags", values.flagged("clean_flags", F.col("_z") & ~large, "large_order_kept"))
    kept = kept.withColumn("clean_flags", values.flagged("clean_flags", ~F.col("_z") & large, "qty_over_limit_review"))
    return kept.drop("_z"), removed.drop("_z")


def filled_by_mode(df: DataFrame, column: str, by: str, where: Column, mark: str = "_filled") -> DataFrame:
    """df with nulls of a column, where a condition holds, filled by the group's most frequent value.

    The least of equally frequent values is taken; mark tells which rows were filled.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(by, column).agg((-F.count(F.lit(1))).alias("_n"))  # one group's values are counted by all tasks
    modes = counts.groupBy(by).agg(F.min_by(column, F.struct("_n", column)).alias("_mode"))
    df = df.join(storage.small(modes), by, "left").withColumn(mark, values.holds(where & F.col(column).isNull()) & F.col("_mode").isNotNull())
    return df.withColumn(column, F.when(F.col(mark), F.col("_mode")).otherwise(F.col(column))).drop("_mode")


def unfilled() -> Column:
    """Does a row lack what can't be filled?"""
    return F.col("qty").isNull() | F.col("unit_price").isNull()


def fill_missing(sales: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """filled(), and the rows that still lack a quantity or a price."""
    return split(filled(sales, products), unfilled())


def filled(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Sizes by price, then by the product's mode; quantities from totals; prices from the list."""
    columns = sales.columns
    listed = products.select("product_id", "category", *(F.col(f"price_{s}").cast("double").alias(f"_{s}") for s in "SML"), F.col("price_nosize").cast("double").alias("_n"))
    df = sales.join(storage.small(listed), "product_id", "left")
    drink = F.col("category").isin(*schemas.DRINKS)
    near = lambda s: F.abs(F.col("unit_price") - F.col(f"_{s}")) <= schemas.PRICE_TOLERANCE
    by_price = F.when(near("L"), "L").when(near("M"), "M").when(near("S"), "S")
    open_size = values.holds(drink & F.col("size").isNull())
    df = df.withColumn("_size", F.when(open_size, by_price))
    df = df.withColumns({"clean_flags": values.flagged("clean_flags", F.col("_size").isNotNull(), "size_from_price"), "size": F.coalesce("size", "_size")})
    df = filled_by_mode(df, "size", "product_id", drink)
    df = df.withColumn("clean_flags", values.flagged("clean_flags", F.col("_filled"), "size_mode")).drop("_filled")
    price = F.when(F.col("category") == schemas.BAKERY, F.col("_n")).when(F.col("size") == "S", F.col("_S")).when(F.col("size") == "M", F.col("_M")).when(F.col("size") == "L", F.col("_L"))
    df = df.withColumn("_price", price)
    ratio = F.try_divide("line_total", "_price")
    whole = values.holds(F.col("qty").isNull() & (ratio > 0) & (F.abs(ratio - values.half_even(ratio)) < 1e-9))
    df = df.withColumns({"clean_flags": values.flagged("clean_flags", whole, "qty_from_total"), "qty": F.when(whole, values.half_even(ratio)).otherwise(F.col("qty"))})
    lacks = F.col("unit_price").isNull() & F.col("_price").isNotNull()
    df = df.withColumns({"clean_flags": values.flagged("clean_flags", lacks, "price_from_list"), "unit_price": F.coalesce("unit_price", "_price")})
    return df.select(*columns)


def total_lines(sales: DataFrame) -> DataFrame:
    return sales.withColumn("line_total", F.col("qty") * F.col("unit_price"))


@dataclass(frozen=True)
class Cleaned:
    """Clean tables; sales and members still hold `_changed` and `_notes`, which written() counts and drops."""

    sales: DataFrame
    members: DataFrame
    removed: DataFrame
    merged: DataFrame
    log: DataFrame | None = None

    def written(self, folder: str) -> Cleaned:
        """All tables from files below folder, with the log: its counts are taken by the tasks that write, without a job of their own."""
        listed, spark, counts, tables = entries(), self.sales.sparkSession, {}, {}
        for source, name in (("sales", "clean_sales"), ("members", "clean_members"), ("removed", "removed"), ("merged", "merged_members")):
            measures = {e.name: F.count_if(e.condition) for e in listed if e.source == source}
            tables[source], got = storage.observed(getattr(self, source), f"{folder}/{name}", measures, ["_changed", "_notes"])
            counts |= got
        rows = [(e.step, e.table, e.name, e.rule, e.problem, e.technique, e.action, counts[e.name], e.chapter) for e in listed]
        return Cleaned(**tables, log=storage.kept(spark.createDataFrame(rows, LOG).coalesce(1), f"{folder}/cleaning_log"))


def clean(sales: DataFrame, members: DataFrame, products: DataFrame, year: int = 2026) -> Cleaned:
    """All steps in their order; birth years are imputed apart, see millrace.operators.imputation."""
    removed = None

    def out(rows: DataFrame, reason: str) -> None:
        nonlocal removed
        rows = rows.withColumn("removed_reason", F.lit(reason))
        removed = rows if removed is None else removed.unionByName(rows, allowMissingColumns=True)

    differs = lambda a, b, name: F.when(~F.col(a).eqNullSafe(F.col(b)), name)
    standard = standardize_members(members.withColumns({"_name": F.col("full_name"), "_phone": F.col("phone")}))
    standard = standard.withColumn("_notes", F.array_compact(F.array(differs("_name", "full_name", "name_spaces"), differs("_phone", "phone", "phone_form")))).drop("_name", "_phone")
    merged, id_map = merge_members(standard)
    dated = fix_birth_year(merged.withColumn("_year", F.col("birth_year")), year)
    notes = F.when(F.col("birth_year") == F.col("_year") - 543, "birth_year_be").when(F.col("birth_year").isNull() & F.col("_year").isNotNull(), "birth_year_impossible")
    people = fill_gender(dated.withColumn("_notes", F.array_compact(F.array_append("_notes", notes))).drop("_year"))

    df, gone = remove_duplicates(sales.withColumn("clean_flags", F.array().cast("array<string>")))
    out(gone, "duplicate")
    df, gone = split(fix_products(df, products), F.col("product_id").isNull())
    out(gone, "unknown_product")
    df, gone = split(fix_members(df, people, id_map.drop("_notes")), F.col("qty") <= 0)
    out(gone, "non_positive_qty")
    df, gone = judge_quantities(fix_prices(mark_times(df), products))
    out(gone, "qty_typo")
    df, gone = fill_missing(df, products)
    out(gone, "cannot_fill")
    done = total_lines(df.withColumn("_total", F.col("line_total")))
    changed = values.holds(F.abs(F.col("_total") - F.col("line_total")) > schemas.PRICE_TOLERANCE)
    return Cleaned(done.withColumn("_changed", changed).drop("_total"), people, removed, id_map)
