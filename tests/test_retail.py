import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import write_shop
from millrace.operators import association, cleaning, evaluation, forecast, imputation, rules, serving, star
from millrace.operators.warehouse import ConstraintError, Warehouse
from millrace.plans import retail, schemas
from millrace.sources import files
from millrace.streaming.incremental import stream_into


@pytest.fixture(scope="module")
def shop(tmp_path_factory, spark):
    folder, work = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("work")
    log = write_shop(folder)
    return log, retail.extract(spark, str(folder), str(work)), str(folder)


@pytest.fixture(scope="module")
def cleaned(shop, tmp_path_factory):
    _, found, _ = shop
    return cleaning.clean(found.staging, found.members, found.products).written(str(tmp_path_factory.mktemp("cleaned")))


@pytest.fixture(scope="module")
def tables(shop, cleaned, tmp_path_factory):
    _, found, _ = shop
    people, _ = imputation.impute(cleaned.members, cleaned.sales, found.products)
    return {n: retail._kept(df, str(tmp_path_factory.mktemp(n) / "t")) for n, df in star.build(cleaned.sales, people, found.products, found.holidays, "salt").items()}


def ids(df):
    return sorted({r[0] for r in df.select("receipt_id").collect()})


def test_staging_has_every_row_of_every_file(shop):
    log, found, _ = shop
    counts = {r["branch"]: r["rows"] for r in retail.staging.report(found.staging).collect()}
    assert {b: counts[b] for b in schemas.BRANCHES} == log["counts"]
    assert counts["total"] == sum(log["counts"].values())
    assert found.staging.columns == [*schemas.STAGING, "row_id"]


def test_staging_times_are_local_and_parsed(shop):
    _, found, _ = shop
    row = found.staging.agg(F.count_if(F.col("sale_datetime").isNull()).alias("bad"), F.min("sale_datetime").cast("string").alias("first"), F.max(F.to_date("sale_datetime")).cast("string").alias("last")).first()
    assert row["bad"] == 0 and row["first"].startswith("2026-01-01") and row["last"] == "2026-06-30"


def test_lines_of_files_are_numbered(shop):
    _, found, _ = shop
    for branch in ("nimman", "cmu"):
        lines = sorted(int(r[0]) for r in found.staging.where(F.col("branch") == branch).select("source_row").collect())
        assert lines == list(range(2, len(lines) + 2))


def test_reconciliation_fails_on_a_lost_row(shop):
    _, found, _ = shop
    with pytest.raises(ValueError):
        retail.staging.reconcile(found.staging.where("row_id <> 0"), found.parts)


def test_rules_find_what_was_put_in(shop):
    log, found, _ = shop
    q = rules.assess(found.staging, found.members, found.products, found.received_at)
    scores = {r["rule_id"]: r for r in q.rules.collect()}
    assert len(scores) == 21
    assert scores["UQ1"]["violations"] == 1 + log["duplicate_bill_items"] and scores["UQ2"]["violations"] == 1 and scores["UQ4"]["violations"] == 1
    assert scores["VL1"]["violations"] == 1 and scores["VL2"]["violations"] == 1 and scores["CP7"]["violations"] == len(log["missing_day"])
    assert scores["CS1"]["violations"] == 2 and scores["CS2"]["violations"] == 2 and scores["CP1"]["violations"] == 0
    assert 0 < scores["TM1"]["score"] < 1
    listed = q.details.groupBy("rule_id").count().collect()
    assert {r["rule_id"]: r["count"] for r in listed} == {k: r["violations"] for k, r in scores.items() if r["violations"]}
    assert q.dimensions.count() == 6 and q.overall.first()["weakest"]
    assert {c for c in rules.by_branch(q).columns} >= {*schemas.BRANCHES, "total"}
    assert rules.summary_metrics(q, found.staging, retail.staging.report(found.staging)).first()["errors"] > 0


def test_missing_column_is_measured(shop):
    _, found, _ = shop
    q = rules.assess(found.staging.drop("payment"), found.members, found.products, found.received_at)
    assert q.rules.where("rule_id = 'CP1'").first()["violations"] == 1


def test_cleaning_removes_and_repairs_what_was_put_in(shop, cleaned):
    log, _, _ = shop
    reason = lambda r: ids(cleaned.removed.where(F.col("removed_reason") == r))
    assert reason("duplicate") == log["duplicate_rows"] or set(log["duplicate_rows"]) <= set(reason("duplicate"))
    assert reason("unknown_product") == log["unknown_product"] and reason("non_positive_qty") == log["non_positive"] and reason("qty_typo") == log["typo"]
    flag = lambda f: ids(cleaned.sales.where(F.array_contains("clean_flags", f)))
    assert flag("product_synonym") == log["synonym"] and flag("member_id_fixed") == log["member_fixed"] and flag("member_id_unknown") == log["member_unknown"]
    assert set(log["member_merged"]) <= set(flag("member_id_merged")) and flag("large_order_kept") == log["large_order"] and set(flag("price_fixed_from_list")) == set(log["price"])
    assert flag("qty_from_total") and flag("price_from_list")
    assert cleaned.sales.where("qty <= 0 or unit_price is null or line_total <> qty * unit_price").isEmpty()
    assert cleaned.members.where("member_id = 'M0061'").isEmpty() and cleaned.members.where("gender is null").isEmpty()
    logged = {r["name"]: r for r in cleaned.log.collect()}
    assert set(logged) == {e.name for e in cleaning.entries()} and all(r["problem"] and r["technique"] and r["action"] and r["chapter"] for r in logged.values())
    for name in ("product_synonym", "member_id_fixed", "member_id_unknown", "price_fixed_from_list", "size_mode", "qty_from_total"):
        assert logged[name]["rows"] == cleaned.sales.where(F.array_contains("clean_flags", name)).count() > 0 or name == "size_mode"
    for reason_ in ("duplicate", "unknown_product", "non_positive_qty", "qty_typo"):
        assert logged[reason_]["rows"] == cleaned.removed.where(F.col("removed_reason") == reason_).count() > 0
    assert (logged["merged"]["rows"], logged["birth_year_be"]["rows"], logged["phone_form"]["rows"]) == (1, 1, 1) and logged["price_fixed_from_list"]["quality_rule"] == "AC1"
    assert not {"_changed", "_notes"} & {*cleaned.sales.columns, *cleaned.members.columns}


def test_cleaning_against_truth(spark, shop, cleaned):
    log, found, folder = shop
    truth, people, issues = files.read_truth(spark, folder)
    pairs = retail._kept(evaluation.aligned(cleaned.sales, truth, issues), f"{folder}/pairs")
    got = evaluation.rows(pairs).first()
    n = sum(log["counts"].values()) - len(log["duplicate_rows"]) - log["duplicate_bill_items"]
    assert (got["true_lines"], got["clean_lines"], got["strange"]) == (n, n - 3, 0)
    assert (got["due"], got["removed"], got["removed_rightly"], got["removed_wrongly"]) == (2, 3, 2, 1)  # the unknown product goes too
    assert {r["issue_id"]: (r["lines"], r["removed"], r["kept_true"]) for r in evaluation.by_issue(pairs).collect()} == {"B8": (1, 1, 0), "B10": (1, 1, 0), "C1": (1, 1, 0), "C3": (1, 0, 0), "C2": (1, 0, 1), "A1": (1, 0, 1)}
    fixed = {r["repair"]: r for r in evaluation.repairs(pairs).collect()}
    assert all(fixed[k]["rows"] == fixed[k]["correct"] >= 1 for k in ("product_synonym", "qty_from_total", "price_from_list", "price_fixed_from_list"))
    assert fixed["member_id_fixed"]["rows"] == 1 and set(fixed) == set(evaluation.REPAIRS)
    off = {r["column"]: r["rows"] for r in evaluation.mismatches(pairs).collect()}
    assert off["payment"] == off["sale_datetime"] == off["unit_price"] == 0 and off["qty"] == 1  # the large order's number is not that of the true line
    twice = cleaned.sales.unionByName(cleaned.sales.where("row_id = 500"))  # a repeat meets no true line of its own
    assert evaluation.rows(evaluation.aligned(twice, truth, issues)).first()["strange"] == 1
    flags = cleaning.detect_outliers(cleaning.outlier_features(found.staging, found.products))
    caught = {r["method"]: r for r in evaluation.detectors(flags, found.staging, truth, issues).collect()}
    assert caught["zscore"]["typos"] == 1 and caught["dbscan"]["typos"] == 1
    imputed, _ = imputation.impute(cleaned.members, cleaned.sales, found.products)
    row = evaluation.members(imputed, people).first()
    assert row["members"] == 60 and row["given_years"] == row["given_years_true"] == 59 and row["imputed_error"] is not None
    mined = spark.createDataFrame([("a", "b", True), ("b", "a", False), ("c", "d", True)], "antecedent string, consequent string, passes boolean")
    assert tuple(evaluation.rules(mined, [("a", "b")]).first()) == (2, 2, 1, 1, 1)


def test_cleaning_raises_the_score(shop, cleaned):
    _, found, _ = shop
    before = rules.assess(found.staging, found.members, found.products, found.received_at)
    after = rules.assess(cleaned.sales.drop("time_suspect"), cleaned.members, found.products, found.received_at)
    assert after.overall.first()["overall_avg"] > before.overall.first()["overall_avg"]
    change = {r["rule_id"]: r["score_change"] for r in rules.compare(before, after).collect()}
    assert change["UQ1"] > 0 and change["CS1"] > 0


def test_outlier_methods(shop, cleaned):
    _, found, _ = shop
    flags = cleaning.detect_outliers(cleaning.outlier_features(found.staging, found.products))
    counts = {r["method"]: r for r in cleaning.summarize_outliers(flags).collect()}
    assert counts["zscore"]["over_limit"] == 1 and counts["iqr"]["flagged"] >= 2 and counts["dbscan"]["over_limit"] == 1
    assert 0 < counts["isolation"]["flagged"] < 0.05 * flags.count()


def test_imputation_compares_methods(shop, cleaned):
    _, found, _ = shop
    people, table = imputation.impute(cleaned.members, cleaned.sales, found.products)
    assert people.where("birth_year is null").isEmpty() and people.where("birth_year_imputed").count() == 1
    assert table.where("chosen").count() == 1 and table.count() == 5


def test_star_conserves_turnover_and_hides_persons(cleaned, tables):
    total = cleaned.sales.agg(F.sum("line_total")).first()[0]
    assert tables["fact_sales"].agg(F.sum("line_total")).first()[0] == total
    assert tables["agg_product"].agg(F.sum("revenue")).first()[0] == total
    assert tables["agg_daily"].agg(F.sum("revenue")).first()[0] == pytest.approx(total)
    assert not {"full_name", "phone"} & set(tables["dim_member"].columns)
    sizes = sorted(r["count"] for r in tables["dim_member"].where("n_bills > 0").groupBy("spend_tier").count().collect())
    assert len(sizes) == 3 and sizes[-1] - sizes[0] <= 1


def test_missing_days_are_found(shop, tables):
    log, _, _ = shop
    found = sorted(str(r["date"]) for r in tables["agg_daily"].where("data_missing").collect())
    assert found == sorted(log["missing_day"])
    assert tables["agg_daily"].count() == 3 * 181 and tables["agg_hourly"].count() == 39
    assert tables["fact_sales"].select("sale_line_id").distinct().count() == tables["fact_sales"].count()


def test_basket_is_zero_or_one(tables):
    b = tables["basket"]
    items = [c for c in b.columns if c.startswith("P")]
    assert b.where(" or ".join(f"{c} not in (0, 1)" for c in items)).isEmpty()
    long = association.long_baskets(b, "receipt_id", items)
    assert long.count() == tables["fact_sales"].select("receipt_id", "product_id").distinct().count()


def test_rules_by_hand_and_planted_pair(tables):
    f = tables["fact_sales"]
    long = association.baskets(f, "receipt_id", "product_id")
    mined = association.mine_rules(long, 0.01, 0.2, 1.2)
    r = mined.where("antecedent = 'P02' and consequent = 'P12'").first()
    sets = {}
    for x in long.collect():
        sets.setdefault(x["receipt"], set()).add(x["item"])
    both, a, b, n = sum({"P02", "P12"} <= s for s in sets.values()), sum("P02" in s for s in sets.values()), sum("P12" in s for s in sets.values()), len(sets)
    assert r["passes"] and r["support"] == pytest.approx(both / n) and r["confidence"] == pytest.approx(both / a) and r["lift"] == pytest.approx(both / a / (b / n))
    rate = {x["method"]: x for x in association.hit_rate(long, mined, association.popular_items(long)).collect()}
    assert rate["model"]["cases"] == sum(len(s) for s in sets.values() if len(s) > 1) and rate["model"]["hit_1"] >= rate["baseline"]["hit_1"] - 0.1


def test_recommendations_exclude_what_is_held(spark):
    long = spark.createDataFrame([(k, i) for k in range(10) for i in ("a", "b", "c")], "receipt int, item string")
    mined, popular = association.mine_rules(long, 0, 0, 0), association.popular_items(long)
    picks = association.recommend(spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "c")], "case int, item string"), mined, popular).collect()
    assert sorted((p["case"], p["item"]) for p in picks) == [(1, "b"), (1, "c")]


def test_forecast(tables):
    df = tables["model_features"]
    chosen = forecast.select_model(df)
    assert chosen in forecast.FEATURES
    changed = df.withColumn("revenue", F.when(F.col("month") == 6, F.col("revenue") * 9).otherwise(F.col("revenue")))
    assert forecast.select_model(changed) == chosen  # June is never seen
    predicted, found = forecast.predict(df.where("month < 6"), df.where("month = 6"))
    whole = forecast.moments(df)
    frame = forecast.interactions(df).toPandas()
    for month in (3, 4, 6, 7):  # every nested fit from one aggregate, against the rows themselves
        train = frame[frame.month < month]
        for model, features in forecast.FEATURES.items():
            x = np.column_stack([(train[f[:-2]] - train[f[:-2]].mean()) / train[f[:-2]].std(ddof=0) if f.endswith("_z") else train[f] for f in features]).astype(float)
            weights = np.linalg.lstsq(x, train.revenue.to_numpy(float), rcond=None)[0]
            assert whole.weights(model, month) == pytest.approx(weights, rel=1e-9, abs=1e-6)
    assert found.weights("M1") == pytest.approx(whole.weights("M1", 6), rel=1e-9)
    walked = {(r.month, r.model): r for r in forecast.walk_forward(df).collect()}
    assert {m for m, _ in walked} == {4, 5, 6} and len(walked) == 9
    for month in (4, 5, 6):
        chosen = walked[month, "B1"].chosen
        assert chosen == forecast.select_model(df.where(F.col("month") < month), month - 1)
        direct = {r.model: r for r in forecast.scores(forecast.predict(df.where(F.col("month") < month), df.where(F.col("month") == month))[0]).collect()}
        for model in ("B1", "B2", chosen):
            assert [walked[month, model][c] for c in ("mae", "mae_pct", "rmse", "r2", "bias")] == pytest.approx([direct[model][c] for c in ("mae", "mae_pct", "rmse", "r2", "bias")], rel=1e-9)
    got = {r["model"]: r["mae"] for r in forecast.scores(predicted).collect()}
    assert set(got) == {"B1", "B2", "M1", "M2"} and got["M1"] < 2 * got["B2"]
    week = forecast.next_week(df, tables["agg_daily"], chosen)
    assert week.count() == 21 and week.where("predicted_revenue is null").isEmpty()
    assert forecast.coefficients(df, "M1").count() == len(forecast.FEATURES["M1"])
    assert forecast.residuals(predicted, "M1")["worst_days"].count() == 5


def test_warehouse(spark, tables, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.refresh(tables, "initial")
    assert w.verify(tables).where("not passed").isEmpty()
    first = w.version()
    bad = tables | {"fact_sales": tables["fact_sales"].withColumn("qty", F.when(F.col("sale_line_id") == 5, -5.0).otherwise(F.col("qty")))}
    with pytest.raises(ConstraintError):
        w.refresh(bad)
    assert w.version() == first and w.log().where("status = 'failed'").count() == 1
    swapped = tables["fact_sales"].withColumn("sale_datetime", F.when(F.col("sale_line_id").isin(7, 8), F.lit("2026-01-0" + "1 09:00:00").cast("timestamp") + F.make_interval(hours=F.lit(15) - F.col("sale_line_id"))).otherwise(F.col("sale_datetime")))
    straight = tables["fact_sales"].withColumn("sale_datetime", F.when(F.col("sale_line_id").isin(7, 8), F.lit("2026-01-01 09:00:00").cast("timestamp") + F.make_interval(hours=F.col("sale_line_id"))).otherwise(F.col("sale_datetime")))
    w.refresh(tables | {"fact_sales": straight})
    failed = {r["check"] for r in w.verify(tables | {"fact_sales": swapped}).where("not passed").collect()}
    assert failed == {"content fact_sales"} and w.verify().where("not passed").isEmpty()  # sums of times are equal, rows are not
    part = tables | {"fact_sales": tables["fact_sales"].where("date_key < 20260601")}
    w.refresh(part)
    sent, added = w.load_incremental(tables["fact_sales"])
    assert sent >= added > 0 and w.table("fact_sales").count() == tables["fact_sales"].count()
    assert w.load_incremental(tables["fact_sales"])[1] == 0
    before = w.version()
    w.refresh(part)
    w.load_incremental(tables["fact_sales"], also=lambda f: {"agg_hourly": f.groupBy("hour").count()})
    assert w.version() != before and w.table("agg_hourly").agg(F.sum("count")).first()[0] == tables["fact_sales"].count() and set(w.names()) == set(tables)
    w.refresh(part)
    version, orphan = w.version(), tables["fact_sales"].where("date_key >= 20260601").withColumn("product_id", F.lit("P99"))
    with pytest.raises(ConstraintError):
        w.load_incremental(orphan.withColumn("sale_line_id", F.col("sale_line_id") + 10**9))
    assert w.version() == version and w.table("fact_sales").count() == part["fact_sales"].count()
    w.refresh(tables)
    w.views()
    assert serving.safe_select(spark, "select count(*) n from v_sales_enriched").first()["n"] == tables["fact_sales"].count()
    sales = spark.table("v_sales_enriched")
    assert serving.top_products(sales).groupBy("branch_id").count().where("count > 3").isEmpty()
    assert serving.kpis(sales).first()["bills"] == sales.select("receipt_id").distinct().count()
    assert serving.day_types(w.table("agg_daily")).count() >= 6 and serving.spend_by_age(sales).count() >= 2
    assert serving.trend(w.table("agg_daily")).count() == 543 and serving.heatmap(sales.withColumn("day_of_week", F.weekday("date"))).count() == 13
    assert serving.filtered(sales.withColumn("month", F.month("date")), ["cmu"], (2, 3)).select("branch_id").distinct().count() == 1 and serving.tiers_by_gender(w.table("dim_member")).count() >= 3 and serving.age_counts(w.table("dim_member")).count() >= 2
    asked = serving.run_sample_queries(spark)
    assert len(asked) == 4 and asked["top products of each branch"].count() == 9 and asked["monthly revenue by category"].count() == 18 and not any(df.isEmpty() for df in asked.values())
    assert serving.monthly_categories(sales).count() == 18 and serving.tier_ranges(w.table("dim_member")).count() == 3 and serving.zero_days(w.table("agg_daily")).count() == 2


def test_stream_loads_once(spark, tables, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.refresh(tables | {"fact_sales": tables["fact_sales"].where("date_key < 20260601")})
    source = str(tmp_path / "in")
    tables["fact_sales"].where("date_key >= 20260601").write.parquet(source)
    for _ in range(2):
        facts = spark.readStream.schema(tables["fact_sales"].schema).parquet(source)
        stream_into(w, facts, str(tmp_path / "ckpt")).awaitTermination()
    assert w.table("fact_sales").count() == tables["fact_sales"].count()


@pytest.mark.parametrize("query", ["DELETE FROM x", "DROP TABLE x", "SELECT 1; DELETE FROM x", "", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT * FROM parquet.`/etc`", "INSERT INTO x SELECT 1", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "SELECT /*'*/ reflect('java.lang.System', 'getProperty', 'user.home') /*'*/", "SELECT * FROM text.`../../etc/passwd`", "SELECT (SELECT max(value) FROM text.`../../etc/passwd`) AS v", "SELECT input_file_name()", "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/region.parquet`')", "SELECT (SELECT count(*) FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/region.parquet`')) AS n", "SELECT 1 AS n WHERE 1 IN (SELECT r_regionkey FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/region.parquet`'))", "WITH a AS (SELECT * FROM IDENTIFIER('par' || 'quet.`/root/testdata/sf0.001/region.parquet`')) SELECT * FROM a"])
def test_unsafe_sql_is_refused(spark, query):
    with pytest.raises(ValueError):
        serving.safe_select(spark, query)


def test_safe_sql_allows_any_column_name(spark):
    spark.range(3).selectExpr("id", "id AS `set`", "id AS `add`", "id AS cache").createOrReplaceTempView("odd")
    assert serving.safe_select(spark, "WITH a AS (SELECT `set`, add, cache FROM odd) SELECT * FROM a WHERE cache IN (SELECT id FROM odd)").count() == 3


def test_safe_sql_reads_files_through_views_only(spark, tmp_path):
    spark.range(9).withColumn("name", F.lit("x")).write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("filed")
    assert serving.safe_select(spark, "WITH a AS (SELECT id FROM filed) SELECT * FROM a JOIN filed USING (id) WHERE id IN (SELECT id FROM filed WHERE id > 3)").count() == 5
    assert serving.safe_select(spark, "SELECT count(*) AS n FROM filed WHERE id < :most AND name = :name", args={"most": 4, "name": "x"}).first()["n"] == 4
    assert serving.safe_select(spark, "SELECT count(*) AS n FROM filed WHERE name = ?", args=["x' OR '1'='1"]).first()["n"] == 0
    with pytest.raises(ValueError):
        serving.safe_select(spark, "SELECT * FROM IDENTIFIER(:t)", args={"t": f"parquet.`{tmp_path}/t`"})


def test_safe_sql_is_limited(spark):
    assert serving.safe_select(spark, "select id from range(5000)").count() == serving.MOST_ROWS


def test_whole_run(spark, shop, tmp_path):
    steps = []
    got = retail.run(spark, shop[2], str(tmp_path), "salt", lambda i, name: steps.append((i, name)))
    assert [s[1] for s in steps] == list(retail.STEPS) and got["verified"] and got["score_after"] > got["score_before"]
    assert got["staging_rows"] == got["clean_rows"] + got["removed_rows"] and got["rules"] >= 1 and got["forecast_days"] == 21
    warehouse = Warehouse(spark, f"{tmp_path}/warehouse")
    rules_ = warehouse.table("reco_rules")
    assert rules_.count() == got["rules"] and rules_.where("antecedent_name is null or lift <= 0").isEmpty() and got["stable_rules"] <= got["rules"]
    assert warehouse.table("forecast_daily").where("actual_revenue is not null and M1 is not null").count() > 0 and warehouse.table("forecast_walk_forward").select("month").distinct().count() == 3
    assert spark.read.parquet(f"{tmp_path}/rule_sensitivity").count() == len(retail.TRIED) and spark.read.parquet(f"{tmp_path}/rule_lift_by_branch").count() == 3 * got["rules"]
    with pytest.raises(ConstraintError):
        warehouse.refresh({"reco_rules": rules_.withColumn("lift", F.lit(-1.0))}, keep=True)
    assert spark.read.parquet(f"{tmp_path}/cleaning_log").where("rows > 0").count() >= 12 and spark.read.parquet(f"{tmp_path}/rule_examples").select("product_id").distinct().count() == 6
    change = spark.read.parquet(f"{tmp_path}/quality_change")
    assert change.count() == 21 and change.where("rule_id = 'UQ1' and score_change > 0").count() == 1 and spark.read.parquet(f"{tmp_path}/quality_details_before").count() > spark.read.parquet(f"{tmp_path}/quality_details_after").count()
    assert warehouse.table("forecast_residuals_worst_days").count() == 5 and spark.read.parquet(f"{tmp_path}/baskets").where("month is null or date_key is null").isEmpty()
    names = retail.dump(spark, str(tmp_path), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/fact_sales").where("sale_datetime like '2026-0_-__T__:__:__+07:00'").count() == got["clean_rows"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/fact_sales").count() == got["clean_rows"] and "reco_rules" in names


def test_uploads(spark, shop, tmp_path):
    import shutil

    good, bad, uploads = shop[2], tmp_path / "bad", tmp_path / "uploads"
    assert retail.validate_upload(spark, good) == []
    shutil.copytree(good, bad)
    lines = (bad / "members.csv").read_text().replace("phone", "telephone", 1)
    (bad / "members.csv").write_text(lines)
    (bad / "holidays.csv").unlink()
    assert retail.validate_upload(spark, str(bad)) == ["members.csv: phone", "holidays.csv"]
    with pytest.raises(retail.UploadError):
        retail.run_upload(spark, str(bad), str(uploads))
    assert not uploads.exists()
