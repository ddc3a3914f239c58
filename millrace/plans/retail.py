"""The whole retail job: files to staging, quality, cleaning, star schema, warehouse, models."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import calendar
from millrace.operators import association, cleaning, forecast, imputation, rules, staging, star, storage
from millrace.operators.warehouse import Warehouse
from millrace.plans import schemas
from millrace.sources import files

FILES = {"nimman": "nimman_sales.csv", "cmu": "cmu_sales.xlsx", "thaphae": "thaphae_sales.json"}
STEPS = ("extract", "quality", "clean", "transform", "load", "recommend", "forecast")
THRESHOLDS = (0.01, 0.2, 1.2)


@dataclass(frozen=True)
class Extracted:
    parts: dict[str, DataFrame]
    staging: DataFrame
    members: DataFrame
    products: DataFrame
    holidays: DataFrame
    received_at: str


_kept = storage.kept
#: Thresholds whose number of rules and hit rate are compared.
TRIED = ((0.005, 0.1, 1.0), (0.01, 0.1, 1.2), (0.01, 0.2, 1.2), (0.02, 0.2, 1.2), (0.01, 0.3, 1.5))


def extract(spark: SparkSession, raw: str, work: str) -> Extracted:
    """All files of the folder raw; staging is written to work, so that row ids are fixed."""
    products, holidays = files.read_products(spark, f"{raw}/products.csv"), files.read_holidays(spark, f"{raw}/holidays.csv")
    receipts = files.read_receipts(spark, f"{raw}/{FILES['thaphae']}")
    parts = {
        "nimman": staging.standardize_nimman(files.read_nimman(spark, f"{raw}/{FILES['nimman']}"), products),
        "cmu": staging.standardize_cmu(files.read_cmu(spark, f"{raw}/{FILES['cmu']}"), products),
        "thaphae": staging.standardize_thaphae(files.flat_receipts(receipts), products),
    }
    table = _kept(staging.integrate(parts), f"{work}/staging")
    staging.reconcile(table, parts)
    members = _kept(files.read_members(spark, f"{raw}/members.csv").withColumn("row_id", F.monotonically_increasing_id()), f"{work}/members")
    exported = files.receipts_metadata(receipts).select(F.to_timestamp("exported_at").cast("string").alias("t")).first()
    return Extracted(parts, table, members, products, holidays, exported["t"] if exported and exported["t"] else schemas.RECEIVED_AT)


def run(spark: SparkSession, raw: str, work: str, salt: str = "", on_step: Callable[[int, str], None] = lambda i, name: None) -> dict[str, object]:
    """Run all steps and return a summary; tables are in the warehouse below work."""
    on_step(1, STEPS[0])
    found = extract(spark, raw, work)
    on_step(2, STEPS[1])
    before = rules.stored(rules.assess(found.staging, found.members, found.products, found.received_at), work, "before")
    _kept(rules.profile(found.staging), f"{work}/profile_sales")
    score_before = before.overall.first()
    on_step(3, STEPS[2])
    cleaned = cleaning.clean(found.staging, found.members, found.products).written(work)
    sales, removed = cleaned.sales, cleaned.removed
    people, table = imputation.impute(cleaned.members, sales, found.products)
    people = _kept(people, f"{work}/members_imputed")
    after = rules.stored(rules.assess(sales.drop("time_suspect"), people, found.products, found.received_at), work, "after")
    _kept(rules.compare(before, after), f"{work}/quality_change")
    score_after = after.overall.first()
    on_step(4, STEPS[3])
    tables = star.build(sales, people, found.products, found.holidays, salt)
    on_step(5, STEPS[4])
    warehouse = Warehouse(spark, f"{work}/warehouse")
    warehouse.refresh(tables, "initial")
    verified = warehouse.verify()  # against what was observed while they were written
    on_step(6, STEPS[5])
    fact = warehouse.table("fact_sales")
    held = _kept(association.stored_baskets(warehouse.table("basket"), fact), f"{work}/baskets")
    train, test = (held.where(c).select("receipt", "item") for c in ("month < 6", "month = 6"))
    mined = _kept(association.mine_rules(train, *THRESHOLDS), f"{work}/mined")
    late = association.mine_rules(test, *THRESHOLDS, zeros=True)
    placed = held.select("receipt", "branch").distinct()
    warehouse.refresh({"reco_rules": association.rule_table(mined, warehouse.table("dim_product"))}, "rules", keep=True)
    stable = _kept(association.stability(mined, late), f"{work}/rule_stability")
    _kept(association.examples(mined, association.popular_items(train), warehouse.table("dim_product")), f"{work}/rule_examples")
    _kept(association.lift_by_branch(train, placed, mined), f"{work}/rule_lift_by_branch")
    _kept(association.sensitivity(train, test, TRIED), f"{work}/rule_sensitivity")
    hits = {r["method"]: r for r in association.hit_rate(test, mined, association.popular_items(train)).collect()}
    on_step(7, STEPS[6])
    features = warehouse.table("model_features")
    chosen, predictions = forecast.tables(features, warehouse.table("agg_daily"))
    warehouse.refresh(predictions, "forecast", keep=True)
    week = warehouse.table("forecast_next_week")
    return {
        "staging_rows": found.staging.count(), "clean_rows": sales.count(), "removed_rows": removed.count(), "members": people.count(),
        "score_before": score_before["overall_avg"], "score_after": score_after["overall_avg"], "weakest_before": score_before["weakest"], "weakest_after": score_after["weakest"],
        "imputation": table.where("chosen").first()["method"], "verified": verified.where("not passed").isEmpty(), "bills": fact.select("receipt_id").distinct().count(),
        "revenue": fact.agg(F.sum("line_total")).first()[0], "rules": mined.where("passes").count(), "hit_3": hits["model"]["hit_k"], "baseline_hit_3": hits["baseline"]["hit_k"],
        "model": chosen, "forecast_days": week.count(), "stable_rules": stable.where("confidence_other is not null").count(),
    }


def dump(spark: SparkSession, work: str, folder: str) -> list[str]:
    """CSV copies of what a run has left in work and its warehouse; arrays are joined by semicolons."""
    text = lambda c, t: F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else calendar.iso(F.col(c)).alias(c) if t == "timestamp" else F.col(c)
    flat = lambda df: df.select(*(text(c, t) for c, t in df.dtypes))
    frames = [f"quality_{what}_{when}" for when in ("before", "after") for what in ("rules", "dimensions", "details")]
    warehouse, names = Warehouse(spark, f"{work}/warehouse"), ["staging", "clean_sales", "removed", "cleaning_log", "members_imputed", "mined", "rule_examples", "profile_sales", "quality_change", *frames]
    for name in names:
        files.write_csv(flat(spark.read.parquet(f"{work}/{name}")), f"{folder}/{name}")
    for name in warehouse.names():
        files.write_csv(flat(warehouse.table(name)), f"{folder}/{name}")
    return [*names, *warehouse.names()]


class UploadError(ValueError):
    """An upload lacks files or columns."""


def validate_upload(spark: SparkSession, raw: str) -> list[str]:
    """What is missing in an uploaded folder, by file and column; empty if it can be run."""
    expected = {FILES["nimman"]: list(schemas.NIMMAN_COLUMNS), "members.csv": [c.split()[0] for c in schemas.MEMBERS.split(", ")], "products.csv": [c.split()[0] for c in schemas.PRODUCTS.split(", ")], "holidays.csv": [c.split()[0] for c in schemas.HOLIDAYS.split(", ")]}
    found = []
    for name, columns in expected.items():
        try:
            found += [f"{name}: {c}" for c in rules.fits(spark.read.option("header", True).csv(f"{raw}/{name}"), columns)]
        except Exception:
            found.append(name)
    try:
        found += [f"{FILES['cmu']}: {c}" for c in (*schemas.CMU_COLUMNS, schemas.CMU_DATE, schemas.CMU_TIME) if files.read_cmu(spark, f"{raw}/{FILES['cmu']}").where(F.col(f"`{c}`").isNotNull()).isEmpty()]
    except Exception:
        found.append(FILES["cmu"])
    try:
        bill = files.bills(files.read_receipts(spark, f"{raw}/{FILES['thaphae']}")).select("bill.*").first()
        found += [f"{FILES['thaphae']}: {c}" for c in ("receipt_id", "timestamp", "items") if bill is None or bill[c] is None]
    except Exception:
        found.append(FILES["thaphae"])
    return found


def run_upload(spark: SparkSession, raw: str, uploads: str, salt: str = "") -> tuple[str, dict[str, object]]:
    """Run an uploaded folder in a warehouse of its own below uploads; its folder goes if the run fails."""
    if missing := validate_upload(spark, raw):
        raise UploadError("missing: " + ", ".join(missing))
    work = f"{uploads.rstrip('/')}/{uuid.uuid4().hex[:12]}"
    try:
        return work, run(spark, raw, work, salt)
    except Exception:
        path = spark._jvm.org.apache.hadoop.fs.Path(work)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        raise
