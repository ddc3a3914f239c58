import random
import pytest
from pyspark.sql import functions as F

from millrace.functions import calendar, text, values
from millrace.operators import outliers, regression, rules, windows
from millrace.operators.rules import Rule


def one(spark, expression, **columns):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in columns.items()) or "x int"
    return spark.createDataFrame([tuple(columns.values()) or (1,)], schema).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, expected", [("  a   b　c ", "a b c"), ("", ""), (None, None)])
def test_collapse_space(spark, raw, expected):
    assert one(spark, text.collapse_space(F.col("c")), c=raw) == expected


@pytest.mark.parametrize("raw, expected", [("081-234-5678", "0812345678"), ("+66 81 234 5678", "0812345678"), ("12345", "12345"), (None, None)])
def test_phone(spark, raw, expected):
    assert one(spark, text.standard_phone(F.col("c")), c=raw) == expected


def test_normal_form_drops_tone_marks(spark):
    assert one(spark, text.normal_form(F.col("c")), c=" เอสเปรสโซ่ ") == "เอสเปรสโซ"


@pytest.mark.parametrize("raw, expected", [("15/01/2569 08:32", "2026-01-15 08:32:00"), ("31/02/2569 08:32", None), ("2026-01-15", None), (None, None)])
def test_buddhist_datetime(spark, raw, expected):
    assert one(spark, calendar.buddhist_datetime(F.col("c")).cast("string"), c=raw) == expected


@pytest.mark.parametrize("raw, expected", [("12.5", 12.5), (" 7 ", 7.0), ("x", None), ("NaN", None), (None, None)])
def test_number(spark, raw, expected):
    assert one(spark, values.number(F.col("c")), c=raw) == expected


def test_bands_are_closed_or_left_open(spark):
    bands = (("a", 0, 22), ("b", 22, 35))
    assert one(spark, calendar.band(F.col("x"), bands, left_open=True), x=22.0) == "a"
    assert one(spark, calendar.band(F.col("x"), bands, left_open=True), x=0.0) is None


def test_null_violations_are_none(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "q int")
    got = rules.rated(rules.score(df, [Rule("R", "Validity", "t", "", F.col("q") <= 0, F.col("q").isNotNull()), Rule("S", "Validity", "t", "", ~(F.col("q") > 0))])).collect()
    assert [(r["checked"], r["violations"]) for r in got] == [(2, 1), (3, 1)]


@pytest.mark.parametrize("n", [3, 4, 7, 10, 50])
def test_tiers_are_quantile_cuts(spark, n):
    import pandas as pd

    got = {r["v"]: r["tier"] for r in windows.tiers(spark.range(n).select((F.col("id") * 3).alias("v")), ["v"], ["1", "2", "3"]).collect()}
    expected = pd.qcut(pd.Series(range(1, n + 1)).astype(float), 3, labels=["1", "2", "3"]).astype(str).tolist()
    assert [got[3 * k] for k in range(n)] == expected


def test_constant_group_scales_to_zero(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", None), ("b", 1.0), ("b", 3.0)], "g string, v double")
    got = df.select("g", windows.group_minmax(F.col("v"), ["g"]).alias("s")).collect()
    assert sorted((r["g"], r["s"]) for r in got if r["s"] is not None) == [("a", 0.0), ("a", 0.0), ("b", 0.0), ("b", 1.0)]


def test_density_noise(spark):
    df = spark.createDataFrame([(100.0,)] * 12 + [(300.0,)] * 4 + [(None,)], "v double")
    assert {r["v"]: r["dbscan"] for r in outliers.density_noise(df, "v", 3, 10).collect()} == {100.0: False, 300.0: True, None: False}


def test_detectors_on_empty_tables(spark):
    df = spark.createDataFrame([], "v double")
    assert outliers.isolation_forest(outliers.iqr(outliers.zscore(df, "v"), "v"), ["v"], 0.1).count() == 0


def test_metrics_by_hand_and_with_nulls(spark):
    m = regression.metrics(spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (300.0, 330.0)], "a double, p double"), "a", "p").first()
    assert m["mae"] == pytest.approx(50 / 3) and m["rmse"] == pytest.approx((1100 / 3) ** 0.5) and m["bias"] == pytest.approx(10)
    with pytest.raises(Exception, match="without nulls"):
        regression.metrics(spark.createDataFrame([(1.0, None)], "a double, p double"), "a", "p").collect()


def test_least_squares(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.5 + 7).alias("y"))
    fit = regression.least_squares(df, ["x"], "y")
    assert fit.weights[0] == pytest.approx(2.5) and fit.intercept == pytest.approx(7) and fit.residual_sd < 1e-4


def test_ranks_of_many_wide_rows(spark):
    n = 300_000
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        rows = spark.range(n).select(F.xxhash64("id").alias("k"), F.concat(F.lit("x" * 50), F.col("id").cast("string")).alias("wide"))
        got = windows.rank_all(rows, ["k"], "rank").agg(F.count(F.lit(1)), F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.countDistinct("wide")).first()
        assert tuple(got) == (n, n, 1, n, n)
        ranked = windows.rank_all(rows, ["k"], "rank")
        wrong = ranked.select("rank", "k").withColumn("low", F.floor(F.col("rank") / 1000)).groupBy("low").agg(F.min("k").alias("a"), F.max("k").alias("z"))
        spans = [tuple(r) for r in wrong.orderBy("low").select("a", "z").collect()]
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        sizes = [r["count"] for r in windows.tiers(rows, ["k"], ["a", "b", "c"]).groupBy("tier").count().collect()]
        assert sorted(sizes) == [n // 3] * 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_noise_by_brute_force(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(-100, 800)) / 2 for _ in range(300)] + [7.0] * 12 + [None]
    known = [v for v in values if v is not None]
    core = {v for v in known if sum(abs(v - w) <= 2.5 for w in known) >= 6}
    want = {v: not any(abs(v - w) <= 2.5 for w in core) for v in known}
    got = outliers.density_noise(spark.createDataFrame([(v,) for v in values], "v double"), "v", 2.5, 6).collect()
    assert len(got) == len(values) and all(r["dbscan"] == want.get(r["v"], False) for r in got) and 0 < sum(want.values()) < len(want)


def test_isolation_takes_the_same_rows_however_they_lie(spark):
    rows = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 97).cast("double").alias("v"))
    flags = lambda df: sorted(r["row_id"] for r in outliers.isolation_forest(df, ["v"], 0.02, trees=10, key=["row_id"]).where("isolation").collect())
    assert flags(rows) == flags(rows.repartition(7, "v"))
