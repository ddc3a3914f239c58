"""Increments: what they cost, what they find, and the tables that depend on facts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fixtures import write_shop
from millrace.operators import cleaning, imputation, increments, keyfilter, star
from millrace.operators.warehouse import Check, ConflictError, Constraints, ConstraintError, Warehouse
from millrace.plans import retail

RULES = {
    "facts": Constraints(key=["id"], unique=[["a", "b"]], required=["day"], checks=[Check("v", "v >= 0")], foreign=[("kind", "kinds", "kind")]),
    "kinds": Constraints(key=["kind"]),
}
SCHEMA = "id long, a string, b int, day int, v double, kind string"


def facts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(i, day, a=None, b=0, v=1.0, kind="x"):
    return (i, a or f"a{i:06d}", b, day, v, kind)


@pytest.fixture
def house(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"), RULES)
    w.refresh({"facts": facts(spark, [row(i, 1) for i in range(50)]), "kinds": spark.createDataFrame([("x",), ("y",)], "kind string")})
    return w


def test_filters_hold_every_key_and_few_others(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 1000).alias("b"))
    filters = keyfilter.build(rows, [["id"], ["id", "b"]], "v", 40_000)
    sizes = [("id", "v", 40_000), ("id,b", "v", 40_000)]
    ask = lambda df: keyfilter.admitted(spark, filters, keyfilter.keys(df, [["id"], ["id", "b"]]), sizes).groupBy("index").count().collect()
    assert {r["index"]: r["count"] for r in ask(rows)} == {"id": 40_000, "id,b": 40_000}
    other = ask(rows.withColumn("id", F.col("id") + 1_000_000))
    assert sum(r["count"] for r in other) < 0.01 * 80_000
    assert filters.where("index = 'id'").count() == keyfilter.blocks(40_000)


def test_increments_read_only_folders_that_may_match(spark, house, monkeypatch):
    read = []
    inner = Warehouse._read
    monkeypatch.setattr(Warehouse, "_read", lambda self, name, table, only=None: (read.append((name, only)), inner(self, name, table, only))[1])
    versions = []
    for day in range(2, 8):
        assert house.load_incremental(facts(spark, [row(1000 * day + i, day) for i in range(20)]), "facts", ["a", "b"], "day") == (20, 20)
        versions.append(house._current().tables["facts"]["folders"][-1]["version"])
    assert not [r for r in read if r[0] == "facts" and r[1]]  # new keys: no older folder is looked into
    read.clear()
    again = facts(spark, [row(4003, 7), row(9000, 7)])
    assert house.load_incremental(again, "facts", ["a", "b"], "day") == (2, 1)
    assert {tuple(r[1]) for r in read if r[0] == "facts" and r[1]} == {(versions[2],)}  # the folder of day 4, found by its filter


def test_many_increments_equal_a_full_load(spark, tmp_path):
    """MANY_INCREMENTS=200 takes ten minutes."""
    many = int(os.environ.get("MANY_INCREMENTS", "25"))
    rng, every = random.Random(2), {}
    w = Warehouse(spark, str(tmp_path / "w"), {"facts": Constraints(unique=[["a"]])})
    first = [(f"k{i}", 0, i) for i in range(20)]
    every.update({r[0]: r for r in first})
    w.refresh({"facts": spark.createDataFrame(first, "a string, day int, v int")})
    for day in range(1, many + 1):
        sent = {k: (k, day, rng.randrange(9)) for k in (f"k{rng.randrange(4 * day + 20)}" for _ in range(3))}
        new = {k: r for k, r in sent.items() if k not in every}
        assert w.load_incremental(spark.createDataFrame(list(sent.values()), "a string, day int, v int"), "facts", ["a"], "day") == (len(sent), len(new))
        every.update(new)
        w.compact("facts", 8)
    assert sorted(map(tuple, w.table("facts").collect())) == sorted(every.values())
    assert w.folders("facts") <= 8 and w.verify().where("not passed").isEmpty()
    gone = w.vacuum(1)
    assert len(gone) > many // 2 and w.table("facts").count() == len(every)


def test_violations_of_increments_are_those_of_a_full_check(spark, house):
    cases = {
        "unique id": [row(7, 2, a="new")], "unique a, b in the increment": [row(100, 2, a="n"), row(101, 2, a="n", b=1), row(101, 2, a="n", b=2)],
        "check": [row(100, 2, v=-1.0)], "foreign": [row(100, 2, kind="z"), row(101, 2, kind="z")], "null": [(100, "n", 0, 2, 1.0, None), (None, "m", 0, 2, None, "x")],
        "all": [row(7, 2, a="p", v=-2.0, kind="q"), row(8, 2, a="o"), row(8, 2, a="r")],
    }
    version, full = house.version(), Warehouse(spark, house.root + "-full", RULES)
    for name, rows in cases.items():
        with pytest.raises(ConstraintError) as delta:
            house.load_incremental(facts(spark, rows), "facts", ["a", "b"], "day")
        with pytest.raises(ConstraintError) as whole:
            full.refresh({"facts": house.table("facts").unionByName(facts(spark, rows)), "kinds": house.table("kinds")})
        assert sorted(str(delta.value).split("; ")) == sorted(str(whole.value).split("; ")), name
    assert house.version() == version and house.table("facts").count() == 50


def test_parents_must_keep_the_keys_in_use(spark, house):
    with pytest.raises(ConstraintError, match="foreign key kind"):
        house.refresh({"kinds": spark.createDataFrame([("y",)], "kind string")}, keep=True)
    house.refresh({"kinds": spark.createDataFrame([("x",), ("z",)], "kind string")}, keep=True)
    assert house.table("facts").count() == 50


def test_of_two_loads_onto_one_version_one_is_refused(spark, house):
    stale = house._current()
    house.refresh({"kinds": spark.createDataFrame([("x",)], "kind string")}, keep=True)
    with pytest.raises(ConflictError):
        house._publish(stale, "1", stale.tables)
    overtaken = []

    def late(increment):
        if not overtaken:  # another load publishes while this one works
            overtaken.append(1)
            Warehouse(spark, house.root, RULES).load_incremental(facts(spark, [row(700, 3)]), "facts", ["a", "b"], "day")
        return {}

    assert house.load_incremental(facts(spark, [row(700, 3), row(701, 3)]), "facts", ["a", "b"], "day", maintain=late) == (2, 1)
    assert house.table("facts").count() == 52 and house.table("facts").select("id").distinct().count() == 52


def test_replaced_rows_are_those_of_the_newest_folder(spark, house):
    add = lambda rows, old=None: house.load_incremental(facts(spark, [row(rows[0][0], rows[0][1])]), "facts", ["a", "b"], "day", maintain=lambda i: {"held": (spark.createDataFrame([r[:2] for r in rows], "k int, n int"), old)})
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    add([(100, 2), (101, 2)])
    add([(102, 3), (100, 3)], keys(100))
    add([(103, 4), (101, 4), (100, 4)], keys(101, 100))
    assert sorted(map(tuple, house.table("held").collect())) == [(100, 4), (101, 4), (102, 3), (103, 4)]
    house.compact("held")
    assert house.folders("held") == 1 and sorted(map(tuple, house.table("held").collect())) == [(100, 4), (101, 4), (102, 3), (103, 4)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder, work = tmp_path_factory.mktemp("raw"), tmp_path_factory.mktemp("work")
    write_shop(folder)
    found = retail.extract(spark, str(folder), str(work))
    out = cleaning.clean(found.staging, found.members, found.products).written(str(work))
    sales = out.sales
    people = retail._kept(imputation.impute(out.members, sales, found.products)[0], f"{work}/people")
    return {n: retail._kept(df, f"{work}/star/{n}") for n, df in star.build(sales, people, found.products, found.holidays, "salt").items()}, people


def rebuilt(spark, facts, tables, people):
    """The ten tables from all facts at once."""
    dates, products = tables["dim_date"], tables["dim_product"]
    sales = increments.lines(facts, dates, products).drop("category")
    daily = star.agg_daily(sales, dates)
    names = [r[0] for r in products.select("product_id").orderBy("product_id").collect()]
    return {
        "dim_date": dates, "dim_branch": tables["dim_branch"], "dim_product": products, "dim_member": star.dim_member(people, sales, products, "salt"), "fact_sales": facts,
        "agg_daily": daily, "agg_hourly": star.agg_hourly(sales), "agg_product": star.agg_product(sales, products), "basket": star.basket(sales, names, "sale_line_id"), "model_features": star.model_features(daily),
    }


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    order = sorted(a.columns)
    rounded = lambda x: round(x, 5) if isinstance(x, float) else str(x)
    rows = lambda df: sorted((tuple(rounded(x) for x in r) for r in df.select(*order).collect()), key=str)
    assert rows(a) == rows(b)


def test_all_tables_equal_a_rebuild_after_each_increment(spark, built, tmp_path):
    tables, people = built
    facts = tables["fact_sales"]
    first = facts.where("date_key < 20260501")
    w = Warehouse(spark, str(tmp_path / "w"))
    w.refresh(tables | rebuilt(spark, first, tables, people))
    # the second increment completes bills of which the first one had a line only
    half = facts.where("date_key between 20260501 and 20260520 and not (date_key = 20260520 and sale_line_id % 2 = 0)")
    for part in (half, facts):
        w.load_incremental(part, maintain=increments.star_tables)
        sent = facts.where(f"sale_line_id in ({','.join(str(r[0]) for r in w.table('fact_sales').select('sale_line_id').collect())})")
        for name, df in rebuilt(spark, sent, tables, people).items():
            same(w.table(name), df)
    assert sent.count() == facts.count() and w.folders("fact_sales") == 3 and w.folders("basket") == 3
    assert w.load_incremental(facts, maintain=increments.star_tables)[1] == 0
