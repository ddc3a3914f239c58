"""Quality rules, each an applicability and a violation, scored by one aggregate for each table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text, values
from millrace.operators import storage, windows
from millrace.plans import schemas


@dataclass(frozen=True)
class Rule:
    """violates is evaluated on the rows where applies holds; a null violation is none."""

    rule_id: str
    dimension: str
    table: str
    description: str
    violates: Column
    applies: Column | None = None

    @property
    def checked(self) -> Column:
        return F.lit(True) if self.applies is None else values.holds(self.applies)

    @property
    def bad(self) -> Column:
        return self.checked & values.holds(self.violates)


@dataclass(frozen=True)
class Quality:
    rules: DataFrame
    dimensions: DataFrame
    overall: DataFrame
    details: DataFrame


def score(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule_id, dimension, table, description, checked, violations: one pass over df for all rules."""
    counts = [F.count_if(c).alias(f"{r.rule_id}_{k}") for r in rules for k, c in (("checked", r.checked), ("bad", r.bad))]
    entries = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.dimension).alias("dimension"), F.lit(r.table).alias("table"), F.lit(r.description).alias("description"), F.col(f"{r.rule_id}_checked").alias("checked"), F.col(f"{r.rule_id}_bad").alias("violations")) for r in rules))
    return df.agg(*counts).select(F.explode(entries).alias("e")).select("e.*")


def rated(counts: DataFrame, target: float = schemas.TARGET) -> DataFrame:
    ratio = F.when(F.col("checked") == 0, 1.0).otherwise(1 - F.col("violations") / F.col("checked"))
    return counts.withColumn("score", ratio.cast("double")).withColumn("meets_target", F.col("score") >= target)


def details(df: DataFrame, rules: Sequence[Rule], key: str, branch: str, source: Column) -> DataFrame:
    """A row for each violation, with the key, branch and source of its row."""
    names = F.array_compact(F.array(*(F.when(r.bad, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.dimension).alias("dimension"), F.lit(r.table).alias("table"))) for r in rules)))
    out = df.select(names.alias("v"), F.col("row_id").alias("row"), F.col(key).cast("string").alias("key"), F.col(branch).alias("branch"), source.alias("source"))
    return out.select(F.explode("v").alias("v"), "row", "key", "branch", "source").select("v.*", "row", "key", "branch", "source")


def dimensions(rules: DataFrame, target: float = schemas.TARGET) -> DataFrame:
    """Mean and least score of each dimension, and the first of its worst rules."""
    order = F.array_position(F.array(*map(F.lit, schemas.DIMENSIONS)), F.col("dimension"))
    worst = F.min(F.struct("score", "rule_id"))
    out = rules.groupBy("dimension").agg(F.count(F.lit(1)).alias("rules"), F.avg("score").alias("score_avg"), F.min("score").alias("score_min"), worst["rule_id"].alias("worst_rule"))
    return out.withColumn("meets_target", F.col("score_avg") >= target).orderBy(order)


def overall(dims: DataFrame) -> DataFrame:
    return dims.agg(F.avg("score_avg").alias("overall_avg"), F.min("score_avg").alias("overall_min"), F.min_by("dimension", F.struct("score_avg", "dimension")).alias("weakest"))


def expected_price() -> Column:
    """List price of a row joined with products: by size, for bakery the price without size."""
    by_size = F.when(F.col("size") == "S", F.col("price_S")).when(F.col("size") == "M", F.col("price_M")).when(F.col("size") == "L", F.col("price_L"))
    return F.when(F.col("category") == schemas.BAKERY, F.col("price_nosize")).otherwise(by_size).cast("double")


def with_products(sales: DataFrame, products: DataFrame) -> DataFrame:
    listed = products.select("product_id", "category", "price_S", "price_M", "price_L", "price_nosize")
    return sales.join(storage.small(listed), "product_id", "left").withColumn("list_price", expected_price())


def sales_rules() -> list[Rule]:
    c, stamp = F.col, F.col("sale_datetime")
    return [
        Rule("CP2", "Completeness", "sales", "unit price is known", c("unit_price").isNull()),
        Rule("CP3", "Completeness", "sales", "quantity is known", c("qty").isNull()),
        Rule("CP4", "Completeness", "sales", "drinks have a size", c("size").isNull(), c("category").isin(*schemas.DRINKS)),
        Rule("UQ1", "Uniqueness", "sales", "no row is repeated", c("repeat")),
        Rule("VL1", "Validity", "sales", "quantity is positive", c("qty") <= 0, c("qty").isNotNull()),
        Rule("VL2", "Validity", "sales", "sold in opening hours", (F.hour(stamp) < schemas.OPEN_HOUR) | (F.hour(stamp) >= schemas.CLOSE_HOUR), stamp.isNotNull()),
        Rule("VL3", "Validity", "sales", "sold within the period", (F.to_date(stamp) < F.lit(schemas.PERIOD[0]).cast("date")) | (F.to_date(stamp) > F.lit(schemas.PERIOD[1]).cast("date")), stamp.isNotNull()),
        Rule("CS1", "Consistency", "sales", "product is in the product table", c("product_id").isNull(), c("product_raw").isNotNull()),
        Rule("CS2", "Consistency", "sales", "member is in the member table", ~values.holds(c("is_member")), c("member_id").isNotNull()),
        Rule("AC1", "Accuracy", "sales", "unit price is the list price", F.abs(c("unit_price") - c("list_price")) > schemas.PRICE_TOLERANCE, c("unit_price").isNotNull() & c("list_price").isNotNull()),
    ]


def member_rules(received_at: str) -> list[Rule]:
    c = F.col
    age = F.year(F.lit(received_at).cast("timestamp")) - c("birth_year")
    return [
        Rule("CP5", "Completeness", "members", "gender is known", F.coalesce(c("gender"), F.lit(schemas.GENDER_UNKNOWN)) == schemas.GENDER_UNKNOWN),
        Rule("CP6", "Completeness", "members", "birth year is known", c("birth_year").isNull()),
        Rule("UQ3", "Uniqueness", "members", "member id is unique", c("repeat_id")),
        Rule("UQ4", "Uniqueness", "members", "name and phone are unique", c("repeat_person")),
        Rule("VL4", "Validity", "members", "age is possible", (age < schemas.AGES[0]) | (age > schemas.AGES[1]), c("birth_year").isNotNull()),
        Rule("VL5", "Validity", "members", "gender is a known letter", ~c("gender").isin(*schemas.GENDERS), c("gender").isNotNull()),
        Rule("CS3", "Consistency", "members", "phone is in the standard form", ~F.coalesce(c("phone"), F.lit("")).rlike(r"^0[0-9]{9}$")),
    ]


def prepared_sales(sales: DataFrame, members: DataFrame, products: DataFrame) -> DataFrame:
    core = [c for c in sales.columns if c not in ("source_row", "row_id")]
    known = members.select("member_id").distinct().withColumn("is_member", F.lit(True))
    return with_products(windows.mark_repeats(sales, core, ["row_id"]), products).join(known, "member_id", "left")


def prepared_members(members: DataFrame) -> DataFrame:
    person = members.withColumns({"_name": text.collapse_space(F.col("full_name")), "_phone": text.comparable_phone(F.col("phone"))})
    person = windows.mark_repeats(person, ["_name", "_phone"], ["row_id"], "repeat_person")
    return windows.mark_repeats(person, ["member_id"], ["row_id"], "repeat_id").drop("_name", "_phone")


def branch_days(sales: DataFrame, branches: Sequence[str] = schemas.BRANCHES, period: Sequence[str] = schemas.PERIOD) -> DataFrame:
    """Every branch and day of the period, and whether nothing was sold (CP7)."""
    days = sales.sparkSession.range(1).select(F.explode(F.sequence(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date"))).alias("date"))
    grid = days.select(F.explode(F.array(*map(F.lit, branches))).alias("branch"), "date")
    sold = sales.select("branch", F.to_date("sale_datetime").alias("date"), F.lit(True).alias("sold")).distinct()
    return grid.join(sold, ["branch", "date"], "left").withColumn("missing", F.col("sold").isNull()).drop("sold")


def repeated_bills(sales: DataFrame) -> DataFrame:
    """Distinct records receipts[i] of the JSON branch; repeat where the receipt id came before (UQ2)."""
    bills = sales.where(F.col("branch") == "thaphae").select("receipt_id", F.regexp_extract("source_row", r"receipts\[(\d+)\]", 1).try_cast("int").alias("place")).distinct()
    return windows.mark_repeats(bills, ["receipt_id"], ["place"])


def timeliness(sales: DataFrame, received_at: str, volatility: int = schemas.VOLATILITY_DAYS) -> DataFrame:
    """Score of each branch: 1 less the age of its latest sale in units of the volatility (TM1)."""
    age = F.datediff(F.lit(received_at).cast("date"), F.to_date(F.max("sale_datetime")))
    return sales.groupBy("branch").agg(age.alias("days")).withColumn("score", values.within(1 - F.col("days") / volatility, 0.0, 1.0))


def assess(sales: DataFrame, members: DataFrame, products: DataFrame, received_at: str = schemas.RECEIVED_AT) -> Quality:
    """All 21 rules; sales and members have a row_id that orders rows as in their files."""
    spark = sales.sparkSession
    schema = "rule_id string, dimension string, table string, description string, checked long, violations long"
    missing = [c for c in schemas.STAGING if c not in sales.columns]
    sales = sales.withColumns({c: F.lit(None).cast("timestamp" if c == "sale_datetime" else "double" if c in ("qty", "unit_price", "line_total") else "string") for c in missing})
    s, m = prepared_sales(sales, members, products), prepared_members(members)
    grid, bills = branch_days(sales), repeated_bills(sales)
    cp7 = Rule("CP7", "Completeness", "branch-days", "every branch sold every day", F.col("missing"))
    uq2 = Rule("UQ2", "Uniqueness", "thaphae bills", "a bill has one record", F.col("repeat"))
    cp1 = spark.createDataFrame([("CP1", "Completeness", "schema", "all staging columns are there", len(schemas.STAGING), len(missing))], schema)
    counts = cp1.unionByName(score(s, sales_rules())).unionByName(score(m, member_rules(received_at))).unionByName(score(grid, [cp7])).unionByName(score(bills, [uq2]))
    times = timeliness(sales, received_at).agg(F.count(F.lit(1)).alias("checked"), F.avg("score").alias("score"))
    tm1 = times.select(F.lit("TM1").alias("rule_id"), F.lit("Timeliness").alias("dimension"), F.lit("branches").alias("table"), F.lit("data are recent").alias("description"), "checked", F.lit(None).cast("long").alias("violations"), "score", (F.col("score") >= schemas.TARGET).alias("meets_target"))
    rules = rated(counts).unionByName(tm1)
    dims = dimensions(rules)
    found = details(s, sales_rules(), "receipt_id", "branch", F.concat_ws(":", "source_file", "source_row"))
    found = found.unionByName(details(m, member_rules(received_at), "member_id", "home_branch", F.concat(F.lit("members.csv:"), (F.col("row_id") + 2).cast("string"))))
    none = F.lit(None)
    found = found.unionByName(grid.where("missing").select(F.lit("CP7").alias("rule_id"), F.lit("Completeness").alias("dimension"), F.lit("branch-days").alias("table"), none.cast("long").alias("row"), F.concat_ws(" ", "branch", F.col("date").cast("string")).alias("key"), "branch", none.cast("string").alias("source")))
    found = found.unionByName(bills.where("repeat").select(F.lit("UQ2").alias("rule_id"), F.lit("Uniqueness").alias("dimension"), F.lit("thaphae bills").alias("table"), none.cast("long").alias("row"), F.col("receipt_id").alias("key"), F.lit("thaphae").alias("branch"), none.cast("string").alias("source")))
    return Quality(rules, dims, overall(dims), found)


def stored(quality: Quality, folder: str, suffix: str) -> Quality:
    """The frames of a run, written once below folder; dimensions and the overall score come from the written rules."""
    rules = storage.kept(quality.rules.coalesce(1), f"{folder}/quality_rules_{suffix}")
    dims = storage.kept(dimensions(rules).coalesce(1), f"{folder}/quality_dimensions_{suffix}")
    return Quality(rules, dims, overall(dims), storage.kept(quality.details, f"{folder}/quality_details_{suffix}"))


def summary_metrics(quality: Quality, sales: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Error ratio, empty values (CP2-CP6), share of failed translations, rows without a usable sale."""
    empty = F.coalesce(F.sum(F.when(F.col("rule_id").isin("CP2", "CP3", "CP4", "CP5", "CP6"), F.col("violations"))), F.lit(0))
    out = quality.rules.where("violations is not null").agg(F.sum("violations").alias("errors"), F.sum("checked").alias("checks"), empty.alias("empty_values"))
    out = out.withColumn("error_ratio", F.coalesce(F.try_divide("errors", "checks"), F.lit(0.0)))
    if report is not None:
        failed = F.col("datetime_unparsed") + F.col("product_unmatched") + F.col("size_unmapped") + F.col("payment_unmapped")
        out = out.join(report.where("branch = 'total'").select(F.try_divide(failed, "rows").alias("transform_error_rate")))
    dark = F.col("product_id").isNull() | F.col("qty").isNull() | F.col("unit_price").isNull() | values.holds(F.col("qty") <= 0)
    return out.join(sales.agg(F.count_if(dark).alias("dark_rows"), F.avg(dark.cast("double")).alias("dark_share")))


def by_branch(quality: Quality, branches: Sequence[str] = schemas.BRANCHES) -> DataFrame:
    """Violations of each rule by branch, with a total."""
    pivot = quality.details.groupBy("rule_id").pivot("branch", list(branches)).count()
    return pivot.na.fill(0).withColumn("total", sum((F.col(b) for b in branches), F.lit(0)))


def compare(before: Quality, after: Quality) -> DataFrame:
    late = after.rules.select("rule_id", F.col("score").alias("score_after"), F.col("violations").alias("violations_after"))
    out = before.rules.select("rule_id", "dimension", F.col("score").alias("score_before"), F.col("violations").alias("violations_before")).join(late, "rule_id", "left")
    return out.withColumn("score_change", F.col("score_after") - F.col("score_before"))


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: type, non-null, null share, distinct, least, largest and most frequent value.

    Two passes: one wide aggregate, and one count of (column, value) pairs for the top values.
    """
    names = df.columns
    measures = [f(F.col(f"`{c}`")).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("n", F.count), ("d", F.countDistinct), ("a", lambda x: F.min(x).cast("string")), ("z", lambda x: F.max(x).cast("string")))]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *measures)
    kinds = dict(df.dtypes)
    entry = lambda i, c: F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"n_{i}").alias("non_null"), (1 - F.try_divide(f"n_{i}", "rows")).alias("null_share"), F.col(f"d_{i}").alias("distinct"), F.col(f"a_{i}").alias("least"), F.col(f"z_{i}").alias("largest"))
    base = wide.select(F.explode(F.array(*(entry(i, c) for i, c in enumerate(names)))).alias("e")).select("e.*")
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names))).alias("e")).select("e.*").where("value is not null")
    tops = pairs.groupBy("column", "value").count().groupBy("column").agg(F.max(F.col("count")).alias("top_count"), F.min_by("value", F.struct(-F.col("count"), "value")).alias("top_value"))
    return base.join(F.broadcast(tops), "column", "left").withColumn("top_share", F.try_divide("top_count", "non_null"))


def fits(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that an upload lacks."""
    return [c for c in columns if c not in df.columns]


def ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with row_id by a stated order, for tables that come without one."""
    return windows.rank_all(df, order, "row_id").withColumn("row_id", F.col("row_id") - 1) if order else df.withColumn("row_id", F.monotonically_increasing_id())
