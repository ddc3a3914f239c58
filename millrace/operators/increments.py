"""The star's tables after an increment, from sums that can be added instead of from all facts.

A state is a table of sums by a key: of bills, items and revenue by branch and day, by branch and
hour, by product, branch and month, and of what members spent.  An increment's states are added to
those published before.  Only bills need a look back: a receipt that has lines in older folders,
which the receipts' filter finds, counts once more than before only where it did not count yet.

Sums of doubles are added in another order than a rebuild does, and agree with it but for rounding.
`items_in_bill` of lines that are loaded already stays as it was when they were sent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import star, storage
from millrace.operators.warehouse import Change, Increment

#: State: its key.
STATES = {
    "state_daily": ["branch", "date"], "state_hourly": ["branch", "hour"], "state_product": ["product_id", "branch", "month"],
    "state_member": ["member_id"], "state_member_category": ["member_id", "category"], "state_member_branch": ["member_id", "branch"],
}
#: States with bills: what tells the groups apart in which a bill counts once.
BILLED = {"state_daily": ["branch", "date"], "state_hourly": ["branch", "hour", "time_suspect"], "state_member": ["member_id"]}
MARKS = {s: f"_bill_{s}" for s in BILLED}
ROLLED = ("total_spent", "n_bills", "n_items", "first_purchase", "last_purchase", "favorite_category", "favorite_branch", "spend_tier")


def lines(facts: DataFrame, dates: DataFrame, products: DataFrame) -> DataFrame:
    """Facts as the star's functions read sales, with the category of the product."""
    out = facts.withColumnRenamed("branch_id", "branch").join(storage.small(dates.select("date_key", "date", "month")), "date_key", "left")
    return out.join(storage.small(products.select("product_id", "category")), "product_id", "left")


def marked(sales: DataFrame) -> DataFrame:
    """sales with a mark for each state of bills, on one line of each bill that the old lines have not got yet.

    Receipts are dealt out once for all marks; bills are then sums, and no state has to tell them apart.
    """
    first = lambda key: F.row_number().over(Window.partitionBy("receipt_id", *key).orderBy(F.desc("old"))) == 1
    new = F.col("receipt_id").isNotNull() & ~F.col("old")
    return sales.repartition("receipt_id").withColumns({MARKS[s]: first(key) & new for s, key in BILLED.items()})


def states(sales: DataFrame) -> dict[str, DataFrame]:
    """Sums of the lines that are not `old`; bills are those that the old lines have not got yet.

    Sales that are not marked yet are marked and written first, so that they are evaluated once.
    """
    if not set(MARKS.values()) <= set(sales.columns):
        needed = {"old", "qty", "line_total", "date", "time_suspect", *(c for key in STATES.values() for c in key)}
        sales = storage.written(marked(sales).select(*(c for c in sales.columns if c in needed), *MARKS.values()), "marked")
    fresh = ~F.col("old")
    bills = lambda state: F.count_if(F.col(MARKS[state]))
    of = lambda c, f=F.sum: f(F.when(fresh, F.col(c)))

    def by(df: DataFrame, state: str, **measures: Column) -> DataFrame:
        grouped = df.groupBy(*STATES[state]).agg(F.count_if(fresh).alias("_fresh"), *(m.alias(n) for n, m in measures.items()))
        return grouped.where("_fresh > 0").drop("_fresh")

    own = sales.where("member_id is not null")
    return {
        "state_daily": by(sales, "state_daily", bills=bills("state_daily"), items=of("qty"), revenue=of("line_total")),
        "state_hourly": by(sales.where("not time_suspect"), "state_hourly", bills=bills("state_hourly"), revenue=of("line_total")),
        "state_product": by(sales, "state_product", qty=of("qty"), revenue=of("line_total")),
        "state_member": by(own, "state_member", total_spent=of("line_total"), n_bills=bills("state_member"), n_items=of("qty"), first_purchase=of("date", F.min), last_purchase=of("date", F.max)),
        "state_member_category": by(own.where("category is not null"), "state_member_category", line_total=of("line_total")),
        "state_member_branch": by(own, "state_member_branch", line_total=of("line_total")),
    }


def added(state: str, *parts: DataFrame) -> DataFrame:
    """Partial states put together."""
    both, key = reduce(DataFrame.unionByName, parts), STATES[state]
    how = {"first_purchase": F.min, "last_purchase": F.max}
    return both.groupBy(*key).agg(*(how.get(c, F.sum)(c).alias(c) for c in both.columns if c not in key))


def star_tables(increment: Increment) -> dict[str, Change]:
    """What becomes of the tables that depend on facts, for Warehouse.load_incremental(maintain=...).

    Where there are no states yet, they are taken from all published facts, once.
    """
    dates, products = increment.table("dim_date"), increment.table("dim_product")
    new = lines(increment.rows, dates, products).withColumn("old", F.lit(False))
    before = increment.found(["receipt_id"])
    touched = new if before is None else new.unionByName(lines(before, dates, products).withColumn("old", F.lit(True)))
    touched = storage.written(marked(touched), "touched")
    try:
        known = {s: increment.table(s) for s in STATES}
    except KeyError:
        known = states(lines(increment.table("fact_sales"), dates, products).withColumn("old", F.lit(False)))
    merged = {s: storage.written(added(s, known[s], part), s) for s, part in states(touched).items()}
    favourites = [star.favourite(merged[f"state_member_{k}"], "member_id", k, f"favorite_{k}") for k in ("category", "branch")]
    rolled = reduce(lambda a, b: a.join(b, "member_id", "left"), favourites, merged["state_member"])
    daily = storage.written(star.daily_table(merged["state_daily"], dates), "daily")
    shelf = increment.table("basket")
    held = star.basket(touched, [c for c in shelf.columns if c not in ("receipt_id", "branch")], "sale_line_id").select(*shelf.columns)
    return merged | {
        "agg_daily": daily, "agg_hourly": star.hourly_table(merged["state_hourly"]), "agg_product": star.product_table(merged["state_product"], products),
        "model_features": star.model_features(daily), "dim_member": star.with_spending(increment.table("dim_member").drop(*ROLLED), rolled),
        "basket": (held, None if before is None else before.select("receipt_id").distinct()),
    }
