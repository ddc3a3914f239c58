"""Operators against brute force: selection, density, pairs and thresholds."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import association, outliers


@pytest.mark.parametrize("kind", ["distinct", "skewed", "ties", "extreme"])
def test_quantiles_are_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(outliers, "FEW", 64)
    monkeypatch.setattr(outliers, "PARTS", 64)
    rng = np.random.default_rng(3)
    values = {"distinct": rng.permutation(3001) / 7, "skewed": np.exp(rng.normal(size=2000) * 20), "ties": rng.integers(0, 5, 1000).astype(float), "extreme": np.append(rng.normal(size=50), [1.7e308, -1.7e308, 5e-324, np.inf, -np.inf])}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999] if kind != "extreme" else [0.25, 0.5, 0.75]
    assert outliers.quantiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    ranks = list(range(0, len(values), 237))
    assert outliers.order_statistics(df, "v", ranks) == {r: np.sort(values)[r] for r in ranks}
    assert outliers.quantiles(df.where("false"), "v", [0.5]) == [None]


def test_noise_where_most_values_lie_in_one_width(spark):
    rng = random.Random(4)
    values = [rng.random() for _ in range(900)] + [rng.random() * 400 for _ in range(100)] + [0.5] * 200
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    for eps, least in ((1.0, 5), (2.5, 3), (0.001, 2)):
        near = lambda v: [w for w in values if v - eps <= w <= v + eps]  # noqa: B023, E731
        cores = {v for v in set(values) if len(near(v)) >= least}
        noise = Counter(v for v in values if not any(w in cores for w in near(v)))
        found = Counter(r["v"] for r in outliers.density_noise(df, "v", eps, least).where("dbscan").collect())
        assert found == noise
    dealt = outliers.near_sums(spark.createDataFrame([(v, 1) for v in sorted(set(values))], "_v double, n int"), "n", 1.0)
    assert dealt.count() == len(set(values))


def plain_pairs(baskets):
    return Counter(p for items in baskets.values() for p in permutations(sorted(items), 2))


def test_pairs_of_large_receipts_are_dealt_out(spark):
    rng = random.Random(5)
    baskets = {r: {f"i{rng.randrange(60)}" for _ in range(rng.randint(1, 6))} for r in range(40)} | {99: {f"i{k}" for k in range(55)}, 98: {f"i{k}" for k in range(9)}}
    long = spark.createDataFrame([(r, i) for r, items in baskets.items() for i in items], "receipt int, item string")
    for cell in (256, 8, 3):
        assert {(r["antecedent"], r["consequent"]): r["count_ab"] for r in association.pair_counts(long, cell).collect()} == plain_pairs(baskets)
    mined = association.mine_rules(long, 0.0, 0.0, 0.0)
    every = association.mine_rules(long, 0.0, 0.0, 0.0, zeros=True)
    items = {i for s in baskets.values() for i in s}
    assert mined.count() == len(plain_pairs(baskets)) and every.count() == len(items) * (len(items) - 1)
    assert every.where("count_ab > 0").exceptAll(mined).isEmpty()


def test_thresholds_in_one_pass_equal_the_loop(spark):
    rng = random.Random(6)
    make = lambda n, at: spark.createDataFrame([(r, f"i{min(rng.randrange(9), rng.randrange(9))}") for r in range(at, at + n) for _ in range(rng.randint(1, 4))], "receipt int, item string").distinct().cache()
    train, test = make(80, 0), make(40, 1000)
    tried = [(0.0, 0.0, 0.0), (0.02, 0.1, 0.8), (0.05, 0.2, 1.0), (0.05, 0.4, 1.2), (0.9, 0.9, 9.0)]
    found = {(r["min_support"], r["min_confidence"], r["min_lift"]): r for r in association.sensitivity(train, test, tried).collect()}
    popular = association.popular_items(train)
    for t in tried:
        mined = association.mine_rules(train, *t)
        model = {r["method"]: r for r in association.hit_rate(test, mined, popular).collect()}["model"]
        assert found[t]["rules"] == mined.where("passes").count()
        assert (found[t]["hit_1"], found[t]["hit_k"]) == pytest.approx((model["hit_1"], model["hit_k"]))
    assert association.examples(association.mine_rules(train, *tried[1]), popular, spark.createDataFrame([("i0",), ("none",)], "product_id string")).groupBy("product_id").count().where("count = 3").count() == 2
    assert association.sensitivity(train, test.where("false"), tried).where(F.col("hit_1").isNull()).count() == 5
