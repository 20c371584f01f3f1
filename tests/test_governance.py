"""Freshness of sources that were never loaded, retention starts, and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators.policy import apply_policy
from ledgerloom.plans.governance import LEAK_TABLES, freshness_check, leaks, pii_leak_scan, retention_due, retention_starts
from ledgerloom.plans.gold import GOLD
from ledgerloom.plans.quality import by_term
from ledgerloom.plans.silver import SILVER
from ledgerloom.sources.lake import Lake
from tests.conftest import SMALL
from tests.test_plans import plan


def test_source_that_was_never_loaded_is_not_fresh(spark):
    lake = Lake(spark, SMALL)
    lake.pin("bronze_kyc_records", lake.bronze("kyc_records").where(F.lit(False)))
    rows = {(r["product"], r.asset): r for r in freshness_check(lake).collect()}
    for asset in ("silver_kyc_records", "gold_aml_risk_scoring"):
        row = rows["Customer Intelligence 360", asset]
        assert row.fresh is False and row.age_minutes is None


def test_retention_covers_every_table_and_spares_live_accounts(spark):
    lake = Lake(spark, SMALL)
    rows = {r.table_name: r for r in retention_due(lake).collect()}
    assert set(rows) == set(SILVER)
    assert (rows["kyc_records"].retention_years, rows["gl_entries"].retention_years, rows["loans"].retention_years) == (7, 7, 5)
    live = lake.silver("accounts").where("account_status = 'Active'").count()
    assert retention_starts(lake, "accounts").where("start is not null").count() <= rows["accounts"].rows_total - live


def test_all_terms_have_results(spark):
    assert {r.term for r in by_term(Lake(spark, SMALL)).collect()} == {"fico-score", "tin", "cusip", "isin", "account-balance"}


def test_tokens_depend_on_the_key(spark):
    people = Lake(spark, SMALL).silver("customers").limit(5)
    one, two = (apply_policy(people, "silver_customers", "internal", k).select("first_name").collect() for k in ("a", "b"))
    assert not {r[0] for r in one} & {r[0] for r in two}


def test_leak_scan_reads_every_silver_and_gold_table(spark):
    assert set(LEAK_TABLES) == {f"silver_{n}" for n in SILVER} | {f"gold_{n}" for n in GOLD}
    lake = Lake(spark, SMALL)
    found = {}
    for table, column, value, pattern in (
            ("silver_counterparties", "counterparty_name", "a.b@example.org", "email"), ("gold_fraud_analytics", "alert_type", "123-45-6789", "ssn")):
        lake.pin(table, lake(table).limit(3).withColumn(column, F.lit(value)).localCheckpoint())
        found[table, column, pattern] = lake(table).count()
    got = {(r.table_name, r.column_name, r.pattern): r.hits for r in pii_leak_scan(lake).collect()}
    assert all(n > 0 and got[key] == n for key, n in found.items())


def test_leaks_are_counted_by_column_and_pattern_without_rebuilding_rows(spark):
    rows = [("123-45-6789", "x"), ("1-2", None), ("a-123-45-6789-b (555) 123-4567", "a.b@example.org"), (None, "no@where"), ("--", ""), ("12-345-6789", "(5) 5-5")]
    df = spark.createDataFrame(rows, "one string, `two b` string").selectExpr("*", "1 as n")
    found = leaks(df, "t")
    assert {tuple(r) for r in found.collect()} == {("t", "one", "ssn", 2), ("t", "one", "phone", 1), ("t", "two b", "email", 1)}
    assert leaks(df.select("n"), "t") is None
    assert "lambda" not in plan(found)
