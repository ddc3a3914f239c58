"""Hot keys: executed plans with low thresholds and half of the rows on one key."""

import contextlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import common, line_dedup, secret_scan

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "32k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@contextlib.contextmanager
def low(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def saved_plans(monkeypatch):
    plans, inner = {}, common.save
    monkeypatch.setattr(common, "save", lambda df, name, *a, **b: (plans.__setitem__(name, executed(df)), inner(df, name, *a, **b))[1])
    return plans


def test_a_hot_window_is_split(spark, docs, saved_plans):
    rng = random.Random(1)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(8))
    hot = "\n".join(["the same line of this corpus"] * 40)
    df = docs(*[(i, "\n".join([hot, *(line() for _ in range(40))])) for i in range(400)]).repartition(16)
    with low(spark):
        line_dedup.covered(df).count()
    assert "skew=true" in saved_plans["repeated"]


def test_a_hot_value_is_split(spark, docs):
    rng = random.Random(2)
    value = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30))
    df = docs(*[(i, " ".join(["password=changeme123456"] * 30 + [f"token={value()}" for _ in range(30)])) for i in range(400)]).repartition(16)
    with low(spark):
        _, spans = secret_scan.scan(df, F.lit("r"), F.lit("o"))
        plan = executed(spans)
    assert "skew=true" in plan
