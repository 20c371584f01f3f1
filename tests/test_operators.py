from __future__ import annotations

import sys
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom import oracle_catalog
from ledgerloom.catalog import QUERIES
from ledgerloom.operators.aligned import append_aligned
from ledgerloom.operators.closure import closure
from ledgerloom.operators.fanout import Arm, join_groups, left_join_many, side_by_side
from ledgerloom.operators.latest import latest
from ledgerloom.operators.policy import apply_policy
from ledgerloom.plans.gold.risk import sample_stddev
from ledgerloom.sources.refdata import FEE_TIERS, in_range
from tests.conftest import SMALL
from tests.support import TABLES, difference


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_latest_keeps_the_newest_row(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c"), (2, None, "d")], "k int, created_at int, v string")
    assert rows(latest(df, "k")) == [(1, 9, "b"), (2, 1, "c")]


def test_latest_settles_ties_the_same_way_in_any_order(spark):
    data = [(1, 5, v) for v in "abcdefgh"]
    schema = "k int, created_at int, v string"
    picks = {rows(latest(spark.createDataFrame(d, schema).repartition(n), "k"))[0]
             for d in (data, data[::-1]) for n in (1, 3, 8)}
    assert len(picks) == 1


def test_latest_settles_ties_by_the_columns_in_their_order(spark):
    data = [(1, 5, "a", 9), (1, 5, "c", None), (1, 5, "c", 1), (1, 4, "z", 9), (2, 5, None, 7), (2, 5, "", 0)]
    df = spark.createDataFrame(data, "k int, created_at int, v string, w int")
    assert rows(latest(df, "k")) == [(1, 5, "c", 1), (2, 5, "", 0)]


def test_silver_is_that_of_its_sql_where_keys_are_cut_to_their_width(spark, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'" if t != "supplier" else
                    f"CREATE TABLE {t} AS SELECT t.* REPLACE (s_suppkey + i * 10 AS s_suppkey) FROM range(1200) r(i), '{SMALL}/{t}.parquet' t")
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    for name in ("silver_advisors", "silver_branches", "silver_cost_centers"):
        got, want = QUERIES[name](spark, str(tmp_path)), con.execute(oracle_catalog()[name])
        assert not difference(got.columns, [tuple(r) for r in got.collect()], [d[0] for d in want.description], want.fetchall()), name


def test_latest_is_idempotent(spark, lake):
    once = latest(lake.bronze("customers"), "customer_id")
    assert rows(latest(once, "customer_id")) == rows(once)
    assert once.count() < lake.bronze("customers").count()


def test_side_by_side_equals_the_plain_join_under_skew(spark):
    parent = spark.range(0, 6).select(F.col("id").alias("k"))
    # key 0 holds a third and more of each child; key 5 has no child at all
    a = spark.range(0, 60).select(F.when(F.col("id") < 30, 0).otherwise(F.col("id") % 4).alias("k"), F.col("id").alias("x"))
    b = spark.range(0, 40).select(F.when(F.col("id") < 20, 0).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("y"))
    plain = parent.join(a, "k", "left").join(b, "k", "left").groupBy("k").agg(
        F.sum("x").alias("x"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    arms = [Arm(a.groupBy("k").agg(F.count(F.lit(1)).alias("a"), F.sum("x").alias("x")), "a", ("x",)),
            Arm(b.groupBy("k").agg(F.count(F.lit(1)).alias("b"), F.sum("y").alias("y")), "b", ("y",))]
    assert rows(side_by_side(parent, "k", arms, rows_as="n").select("k", "x", "y", "n")) == rows(plain)
    once = {r.k: (r.x, r.y) for r in side_by_side(parent, "k", arms, repeat=False).collect()}
    assert once[0] == (sum(range(30)) + sum(i for i in range(30, 60) if i % 4 == 0),
                       sum(range(20)) + sum(i for i in range(20, 40) if i % 3 == 0))
    assert once[5] == (None, None)


def test_left_join_many_keeps_childless_parents(spark):
    parent = spark.createDataFrame([(1, "p"), (2, "q")], "k int, name string")
    child = spark.createDataFrame([(1, 10), (1, 11), (3, 12)], "k int, v int")
    expected = parent.join(child, "k", "left").select("k", "name", "v")
    assert rows(left_join_many(parent, child, "k").select("k", "name", "v")) == rows(expected)


def test_join_groups_matches_null_groups(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "g string, x int")
    right = spark.createDataFrame([(None, 3), ("a", 4)], "g string, y int")
    assert rows(join_groups(left, right, ["g"])) == [("a", 2, 4), (None, 1, 3)]


def test_stddev_from_moments(spark):
    values = [1.5, -0.25, 3.0, 3.0, 0.75]
    df = spark.createDataFrame([(Decimal(str(v)),) for v in values], "v decimal(10,4)")
    row = df.agg(
        sample_stddev(F.count("v"), F.sum("v"), F.sum(F.col("v") * F.col("v"))).alias("a"),
        F.stddev_samp(F.col("v").cast("double")).alias("b")).first()
    assert row.a == pytest.approx(row.b, rel=1e-12)
    single = df.limit(1).agg(sample_stddev(F.count("v"), F.sum("v"), F.sum(F.col("v") * F.col("v"))).alias("a"))
    assert single.first().a is None


def test_closure_terminates_on_cycles(spark):
    edges = spark.createDataFrame(
        [("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "e"), ("f", None)], "child string, parent string")
    pairs = {(r.ancestor, r.descendant): r.depth for r in closure(edges, "child", "parent").collect()}
    assert pairs[("a", "b")] == 1 and pairs[("a", "c")] == 2 and pairs[("a", "a")] == 3
    assert pairs[("a", "d")] == 3 and pairs[("e", "e")] == 1
    assert not any(d == "f" for _, d in pairs)


def test_append_aligned_fills_and_refuses(spark):
    target = spark.createDataFrame([(1, "x")], "a int, b string")
    assert rows(append_aligned(target, spark.createDataFrame([(2,)], "a int"))) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError, match="gender"):
        append_aligned(target, spark.createDataFrame([("U",)], "gender string"))


def test_policy_masks_by_clearance(spark, lake):
    customers = lake.silver("customers")
    low = apply_policy(customers, "silver_customers", "internal", "key")
    assert low.where(F.col("ssn_masked").isNotNull() | F.col("date_of_birth").isNotNull()).isEmpty()
    assert low.join(customers, ["customer_id", "first_name"], "left_semi").isEmpty()
    assert low.schema["first_name"].metadata == {"sensitivity": "sensitive"}
    assert rows(apply_policy(customers, "silver_customers", "highly-sensitive", "key")) == rows(customers)


@pytest.mark.parametrize(("aum", "tier"), [
    (0, "Standard"), (249999, "Standard"), (250000, "Preferred"), (24999999, "Private Banking"), (-1, None)])
def test_ranges_are_closed(spark, aum, tier):
    df = spark.createDataFrame([(aum,)], "v bigint")
    assert df.select(in_range(F.col("v"), [(r[1], r[2], r[0]) for r in FEE_TIERS]).alias("t")).first().t == tier


def test_range_gap_has_no_tier(spark):
    df = spark.createDataFrame([(Decimal("249999.50"),)], "v decimal(18,2)")
    assert df.select(in_range(F.col("v"), [(r[1], r[2], r[0]) for r in FEE_TIERS]).alias("t")).first().t is None


def test_closure_of_a_long_chain_ends_at_its_fixpoint(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 71)], "child string, parent string")
    pairs = closure(edges, "child", "parent")
    assert pairs.count() == 70 * 71 // 2
    assert pairs.agg(F.max("depth")).first()[0] == 70


def test_closure_doubles_its_paths(spark, monkeypatch):
    module = sys.modules[closure.__module__]

    rounds, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: rounds.append(1) or cut(df))
    edges = spark.createDataFrame([(f"n{i}", f"n{i - 1}") for i in range(1, 601)], "child string, parent string")
    pairs = closure(edges, "child", "parent")
    assert pairs.count() == 600 * 601 // 2 and pairs.agg(F.max("depth")).first()[0] == 600
    assert len(rounds) <= 12


@pytest.mark.parametrize("seed", range(2))
def test_closure_gives_shortest_distances(spark, seed):
    import random

    rng = random.Random(seed)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    want = {}
    for start in range(30):
        at, near, depth = {start}, set(), 0
        while at:
            depth += 1
            at = {c for c, p in edges if p in at} - near
            near |= at
            want.update({(start, c): depth for c in at})
    got = closure(spark.createDataFrame(sorted(edges), "child long, parent long"), "child", "parent")
    assert {(r.ancestor, r.descendant): r.depth for r in got.collect()} == want


def test_factors_of_hot_keys_do_not_overflow(spark):
    parent = spark.createDataFrame([(1,)], "k int")
    arms = [Arm(spark.createDataFrame([(1, 4_000_000)], "k int, n long").withColumnRenamed("n", f"n{i}"), f"n{i}") for i in range(3)]
    assert side_by_side(parent, "k", arms, rows_as="joined").first().joined == 4_000_000 ** 3
