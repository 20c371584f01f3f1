"""Exact medians: ties, negative and very large amounts, null keys, groups far beyond a sketch."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom import query_catalog
from ledgerloom.operators.medians import group_medians
from tests.conftest import SMALL
from tests.test_plans import plan


def test_medians_equal_those_of_sorted_lists(spark):
    rng = random.Random(3)
    groups = {
        ("one", None): ["5.00"], (None, 1): ["1.00", "2.00"], ("tie", 1): ["3.10"] * 5 + ["9.99"] * 4, ("none", 2): [None, None],
        ("mixed", 1): ["-9999999999999999.99", "9999999999999999.99", "0.00", None, "-0.01"],
        ("wide", 1): [f"{rng.randrange(-10**17, 10**17) / 100:.2f}" for _ in range(301)],
        ("near", 1): [f"{rng.randrange(10**6) / 100:.2f}" for _ in range(400)]}
    rows = [(*k, v and Decimal(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "a string, b int, v decimal(18,2)").repartition(5)
    got = {(r.a, r.b): r.m for r in group_medians(df, ["a", "b"], "v", "m").collect()}
    want = {}
    for k, vs in groups.items():
        known = sorted(Decimal(v) for v in vs if v is not None)
        if known:
            want[k] = known[(len(known) + 1) // 2 - 1]
    assert got == want


def test_a_group_of_very_many_values_is_exact(spark):
    n = 300_001
    df = spark.range(n).select(F.lit("hot").alias("a"), (F.col("id") * 7919 % n).cast("decimal(18,2)").alias("v"))
    assert [r.m for r in group_medians(df, ["a"], "v", "m").collect()] == [Decimal(n // 2)]


def test_an_empty_table_has_no_medians(spark):
    assert group_medians(spark.createDataFrame([], "a string, v decimal(18,2)"), ["a"], "v", "m").count() == 0


def test_gold_takes_no_sketch(spark):
    assert "approx" not in plan(query_catalog()["gold_transaction_patterns"](spark, SMALL))
