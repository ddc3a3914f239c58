"""What is kept of a step grows with what differs, not with how often it is there."""

from __future__ import annotations

import random

import pytest

from millrace.operators import association, increments, staging, storage
from millrace.plans import carriers


@pytest.fixture
def kept(monkeypatch):
    """Rows of each intermediate table, by name."""
    found, real = {}, storage.written

    def written(df, name):
        out = real(df, name)
        found[name] = max(found.get(name, 0), out.count())
        return out

    monkeypatch.setattr(storage, "written", written)
    return found


def _copies(spark, n):
    """n receipts with the same three items, and one with two of them."""
    rows = [(r, i) for r in range(n) for i in "abc"] + [(n, "a"), (n, "b")]
    return spark.createDataFrame(rows, "receipt int, item string")


def test_lifts_of_branches_come_from_different_baskets(spark, kept):
    long = _copies(spark, 60)
    branches = long.selectExpr("receipt", "concat('x', receipt % 2) as branch").distinct()
    rules = association.mine_rules(long, 0.1, 0.1, 0.5)
    found = {(r["branch"], r["antecedent"], r["consequent"]): r["lift"] for r in association.lift_by_branch(long, branches, rules).collect()}
    assert kept["sets"] == 3  # one of the branch with even receipts more
    assert len(found) == 12 and found["x0", "a", "b"] == 1.0 and found["x1", "b", "c"] == 1.0
    assert [storage.dealt(long, rows, "receipt").rdd.getNumPartitions() for rows in (1, 30 * storage.TASK_ROWS)] == [4, 30]


def test_thresholds_are_tried_once_for_equal_cases(spark, kept):
    tried = ((0.1, 0.1, 0.5), (0.9, 0.9, 0.9))
    for n in (20, 40):
        long = _copies(spark, n)
        found = association.sensitivity(long, long, tried).collect()
        assert (kept["sets"], kept["cases"], kept["shown"]) == (2, 5, 5) and len(found) == 2  # ab, ac, bc, a and b are shown
        assert {(r["hit_1"], r["hit_k"]) for r in found} == {((3 * n + 2) / (3 * n + 2),) * 2}


def _scans(df, column):
    """Leaves of the plan that are read for a column."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(column in leaves.apply(i).toString() for i in range(leaves.size()))


def test_lines_are_repaired_in_one_pass(spark):
    """Lines are read for what is kept, for the modes of sizes and for negative quantities; each id is joined once."""
    found = carriers.sales_repaired(spark, "/root/testdata/sf0.001")
    assert _scans(found, "l_linenumber") == 3
    assert found.where("removed is null").count() + found.where("removed is not null").count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_hits_of_equal_cases_are_found_once(spark, kept):
    long = _copies(spark, 30)
    rates = {r["method"]: r for r in association.hit_rate(long, association.mine_rules(long, 0.1, 0.1, 0.5), association.popular_items(long)).collect()}
    assert (kept["sets"], kept["cases"], kept["shown"]) == (2, 5, 5)
    assert rates["model"]["cases"] == 92 and rates["model"]["hit_k"] == rates["baseline"]["hit_k"] == 1.0


def test_reconciliation_evaluates_staging_once(spark, kept):
    found = carriers.staging_reconciled(spark, "/root/testdata/sf0.001")
    assert (kept["branches"], kept["reconciled"]) == (3, 4) and _scans(found, "l_orderkey") == 0
    rows = [("a", "1", 2.0, ["size_unmapped"]), ("b", "1", 3.0, []), ("b", "2", None, []), ("b", None, 1.0, []), ("a", None, None, ["size_unmapped"])]
    df = spark.createDataFrame(rows, "branch string, receipt_id string, line_total double, extract_flags array<string>")
    got = {r["branch"]: (r["rows"], r["receipts"], r["revenue"], r["size_unmapped"]) for r in staging.report(df).collect()}
    assert got == {"a": (2, 1, 2.0, 2), "b": (3, 2, 4.0, 0), "total": (5, 2, 6.0, 2)}


def test_members_lines_are_joined_once(spark, kept):
    found = carriers.members_rolled(spark, "/root/testdata/sf0.001")
    assert kept["own"] == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() and _scans(found, "l_quantity") == 0


@pytest.mark.parametrize("state", ["state_daily", "state_member"])
def test_states_take_bills_from_lines_marked_once(spark, kept, state):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(12)]), rng.choice("xy"), f"2026-01-0{rng.randint(1, 3)}", rng.randint(7, 9), 1, "p", "c", rng.choice([None, 1, 2]), rng.random() < 0.3, 1, 2, rng.random() < 0.3) for _ in range(200)]
    df = spark.createDataFrame(rows, "receipt_id int, branch string, date string, hour int, month int, product_id string, category string, member_id int, time_suspect boolean, qty int, line_total int, old boolean")
    states = increments.states(df)
    assert kept == {"marked": 200} and "Expand" not in states[state]._jdf.queryExecution().optimizedPlan().toString()
    for name, at, bills, where in (("state_daily", (1, 2), "bills", lambda r: True), ("state_hourly", (1, 3), "bills", lambda r: not r[8]), ("state_member", (7,), "n_bills", lambda r: r[7] is not None)):
        seen = {}
        for r in filter(where, rows):
            olds, news = seen.setdefault(tuple(r[i] for i in at), (set(), set()))
            (olds if r[-1] else news).add(r[0])
        expected = {k: len(news - olds - {None}) for k, (olds, news) in seen.items() if news}
        assert {tuple(r[c] for c in increments.STATES[name]): r[bills] for r in states[name].collect()} == expected
