"""Star schema, dense aggregates and model features from clean sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import calendar, values
from millrace.operators import storage, windows
from millrace.plans import schemas


def spine(spark: SparkSession, period: Sequence[str] = schemas.PERIOD) -> DataFrame:
    """A row for each day of the period."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date"))).alias("date"))


def fixed(spark: SparkSession, name: str, items: Sequence) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, items))).alias(name))


def densified(grid: DataFrame, facts: DataFrame, keys: Sequence[str], fill: dict[str, object]) -> DataFrame:
    """Every row of a grid of bounded spines, with facts or the fill."""
    return grid.join(facts, list(keys), "left").na.fill(fill)


def sale_attributes(sales: DataFrame, holidays: DataFrame) -> DataFrame:
    date = F.to_date("sale_datetime")
    hour = F.hour("sale_datetime")
    off = holidays.select(F.col("date").alias("_day"), F.lit(True).alias("_holiday")).distinct()
    out = sales.withColumns({
        "date": date, "date_key": calendar.date_key(date), "month": F.month(date), "day_of_week": F.weekday(date), "hour": hour,
        "time_of_day": F.when(~values.holds(F.col("time_suspect")), calendar.band(hour, schemas.TIMES_OF_DAY)),
        "items_in_bill": F.count(F.lit(1)).over(Window.partitionBy("receipt_id")), "size_ordinal": values.translated(F.col("size"), schemas.SIZE_ORDINAL),
    })
    return out.join(F.broadcast(off), F.col("date") == F.col("_day"), "left").withColumn("is_holiday", F.coalesce("_holiday", F.lit(False))).drop("_day", "_holiday")


def dim_date(spark: SparkSession, holidays: DataFrame, period: Sequence[str] = schemas.PERIOD) -> DataFrame:
    d = F.col("date")
    days = spine(spark, period).join(F.broadcast(holidays.select("date", F.col("name_th").alias("holiday_name"))), "date", "left")
    return days.select(calendar.date_key(d).alias("date_key"), "date", F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.weekday(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), (F.weekday(d) >= 5).alias("is_weekend"), F.col("holiday_name").isNotNull().alias("is_holiday"), "holiday_name")


def dim_branch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(schemas.BRANCH_INFO, "branch_id string, name_th string, name_en string, source_format string")


def dim_product(products: DataFrame) -> DataFrame:
    return products.select("product_id", "name_th", "name_en", "category", "price_S", "price_M", "price_L", "price_nosize")


def hashed(c: Column, salt: str) -> Column:
    """Salted SHA-256; null stays null."""
    return F.sha2(F.concat(F.lit(salt), c), 256)


def favourite(sales: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """For each key the value with the largest turnover, the first in order among equals."""
    sums = sales.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.sum("line_total").alias("_t"))
    return sums.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_t"), value)).alias(name))


def dim_member(members: DataFrame, sales: DataFrame, products: DataFrame, salt: str, year: int = 2026) -> DataFrame:
    """Members without name and phone, with age group, roll-up of their bills and spending tier."""
    own = sales.where("member_id is not null").join(storage.small(products.select("product_id", "category")), "product_id", "left")
    own = storage.written(own.select("member_id", "receipt_id", "category", "branch", "qty", "line_total", "date"), "own")  # read for the roll-up and both favourites
    rolled = own.groupBy("member_id").agg(F.sum("line_total").alias("total_spent"), F.countDistinct("receipt_id").alias("n_bills"), F.sum("qty").alias("n_items"), F.min("date").alias("first_purchase"), F.max("date").alias("last_purchase"))
    rolled = rolled.join(favourite(own, "member_id", "category", "favorite_category"), "member_id", "left").join(favourite(own, "member_id", "branch", "favorite_branch"), "member_id", "left")
    rolled = storage.written(rolled, "rolled")  # tiers read it several times
    age = year - F.col("birth_year")
    group = calendar.band(age, schemas.AGE_GROUPS, left_open=True)
    ordinal = values.translated(group, {name: k + 1 for k, (name, _, _) in enumerate(schemas.AGE_GROUPS)})
    return with_spending(members.withColumns({"phone_hash": hashed(F.col("phone"), salt), "age": age, "age_group": group, "age_group_ordinal": ordinal}).drop("full_name", "phone"), rolled)


def with_spending(members: DataFrame, rolled: DataFrame) -> DataFrame:
    """Members with the roll-up of their bills and, if they have any, their spending tier."""
    out = members.join(rolled, "member_id", "left").na.fill(0, ["total_spent", "n_bills", "n_items"])
    buyers = out.where("n_bills > 0")
    if buyers.limit(len(schemas.TIERS)).count() < len(schemas.TIERS):
        return out.withColumn("spend_tier", F.lit(schemas.NO_TIER))
    tiered = windows.tiers(buyers, ["total_spent", "member_id"], schemas.TIERS, "spend_tier").select("member_id", "spend_tier")
    return out.join(tiered, "member_id", "left").na.fill({"spend_tier": schemas.NO_TIER})


FACT = "sale_line_id receipt_id date_key sale_datetime hour time_of_day branch_id product_id member_id size size_ordinal qty unit_price line_total items_in_bill time_suspect clean_flags".split()


def fact_sales(sales: DataFrame) -> DataFrame:
    return windows.rank_all(sales.withColumnRenamed("branch", "branch_id"), ["row_id"], "sale_line_id").select(*FACT)


def mark_missing(daily: DataFrame, reach: int = 14, level: float = 0.01) -> DataFrame:
    """Days without bills that chance hardly explains, corrected for the number of rows.

    Bills of a branch and kind of day are taken as Poisson with the mean of the days nearby that
    have bills.  Measures of missing days become null.
    """
    total = daily.agg(F.count(F.lit(1)).alias("_rows"))
    off = F.col("is_weekend") | F.col("is_holiday")
    df = daily.withColumn("_off", off)
    mean = F.coalesce(windows.band_mean(F.col("bills"), ["branch", "_off"], F.col("date"), reach, F.col("bills") > 0), F.lit(0.0))
    df = df.withColumn("_mean", mean).join(F.broadcast(total))
    zero = F.col("bills") == 0
    df = df.withColumns({"expected_bills": F.when(zero, F.col("_mean")), "p_zero": F.when(zero, F.exp(-F.col("_mean")))})
    df = df.withColumn("data_missing", values.holds(zero & (F.col("p_zero") < level / F.col("_rows"))))
    return df.withColumns({c: F.when(~F.col("data_missing"), F.col(c)) for c in ("bills", "items", "revenue", "avg_bill")}).drop("_off", "_mean", "_rows")


def agg_daily(sales: DataFrame, dates: DataFrame, branches: Sequence[str] = schemas.BRANCHES) -> DataFrame:
    facts = sales.groupBy("branch", "date").agg(F.countDistinct("receipt_id").alias("bills"), F.sum("qty").alias("items"), F.sum("line_total").alias("revenue"))
    return daily_table(facts, dates, branches)


def daily_table(facts: DataFrame, dates: DataFrame, branches: Sequence[str] = schemas.BRANCHES) -> DataFrame:
    """agg_daily from bills, items and revenue by branch and date."""
    spark = facts.sparkSession
    grid = dates.select("date", "date_key", "month", "day_of_week", "day_name", "is_weekend", "is_holiday").join(fixed(spark, "branch", branches))
    daily = densified(grid, facts, ["branch", "date"], {"bills": 0, "items": 0, "revenue": 0.0}).withColumn("avg_bill", F.when(F.col("bills") > 0, F.col("revenue") / F.col("bills")))
    return mark_missing(daily).withColumn("revenue_minmax", windows.group_minmax(F.col("revenue"), ["branch"]))


def agg_hourly(sales: DataFrame, branches: Sequence[str] = schemas.BRANCHES) -> DataFrame:
    return hourly_table(sales.where("not time_suspect").groupBy("branch", "hour").agg(F.countDistinct("receipt_id").alias("bills"), F.sum("line_total").alias("revenue")), branches)


def hourly_table(facts: DataFrame, branches: Sequence[str] = schemas.BRANCHES) -> DataFrame:
    spark = facts.sparkSession
    grid = fixed(spark, "branch", branches).join(fixed(spark, "hour", range(schemas.OPEN_HOUR, schemas.CLOSE_HOUR)))
    return densified(grid, facts, ["branch", "hour"], {"bills": 0, "revenue": 0.0}).withColumn("time_of_day", calendar.band(F.col("hour"), schemas.TIMES_OF_DAY))


def agg_product(sales: DataFrame, products: DataFrame, months: Sequence[int] = range(1, 7), branches: Sequence[str] = schemas.BRANCHES) -> DataFrame:
    return product_table(sales.groupBy("product_id", "branch", "month").agg(F.sum("qty").alias("qty"), F.sum("line_total").alias("revenue")), products, months, branches)


def product_table(facts: DataFrame, products: DataFrame, months: Sequence[int] = range(1, 7), branches: Sequence[str] = schemas.BRANCHES) -> DataFrame:
    spark = facts.sparkSession
    grid = products.select("product_id", "name_th", "category").join(fixed(spark, "branch", branches)).join(fixed(spark, "month", list(months)))
    return densified(grid, facts, ["product_id", "branch", "month"], {"qty": 0.0, "revenue": 0.0})


def basket(sales: DataFrame, products: Sequence[str], order: str = "row_id") -> DataFrame:
    """0/1 for each receipt and product, with the receipt's branch, that of its first line."""
    flags = [F.max((F.col("product_id") == p).cast("byte")).alias(p) for p in products]
    return sales.groupBy("receipt_id").agg(F.min_by("branch", order).alias("branch"), *flags)


DAYS = ("Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def model_features(daily: DataFrame, branches: Sequence[str] = schemas.BRANCHES) -> DataFrame:
    """Revenue with lag, trend and dummies; days that are missing or have no lag are left out."""
    start = daily.agg(F.min("date").alias("_start"))
    df = daily.withColumn("lag7_revenue", windows.lagged(F.col("revenue"), ["branch"], ["date"], 7)).join(F.broadcast(start)).withColumn("trend", F.datediff("date", "_start"))
    df = df.where("not data_missing and lag7_revenue is not null")
    dummies = [(F.col("branch") == b).cast("int").alias(f"branch_{b}") for b in sorted(branches)] + [(F.col("day_of_week") == k + 1).cast("int").alias(f"dow_{d}") for k, d in enumerate(DAYS)]
    out = df.select("date", "date_key", "branch", "revenue", "bills", "month", "day_of_week", F.col("is_holiday").cast("int").alias("is_holiday"), "lag7_revenue", "trend", *dummies)
    return windows.scaled(out, ["lag7_revenue", "trend"])


def build(sales: DataFrame, members: DataFrame, products: DataFrame, holidays: DataFrame, salt: str) -> dict[str, DataFrame]:
    """The ten tables, by name."""
    spark = sales.sparkSession
    prepared = sale_attributes(sales, holidays)
    dates = dim_date(spark, holidays)
    daily = agg_daily(prepared, dates)
    names = [r["product_id"] for r in products.select("product_id").orderBy("product_id").collect()]  # the price list
    return {
        "dim_date": dates, "dim_branch": dim_branch(spark), "dim_product": dim_product(products), "dim_member": dim_member(members, prepared, products, salt),
        "fact_sales": fact_sales(prepared), "agg_daily": daily, "agg_hourly": agg_hourly(prepared), "agg_product": agg_product(prepared, products),
        "basket": basket(prepared, names), "model_features": model_features(daily),
    }
