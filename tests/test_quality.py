from __future__ import annotations

import sys
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.aligned import align
from ledgerloom.plans.governance import freshness_check, pii_leak_scan, retention_due
from ledgerloom.plans.quality import SCANNED, all_results, dirty, injected_rows, profile_all, profile_sampled, rerun_delta
from ledgerloom.plans.silver import SILVER, beside, refine
from ledgerloom.quality.engine import evaluate, quarantine
from ledgerloom.quality.profile import Part, column_sketches, merged_profile, part_sketches, portable_sample, profile, summaries
from ledgerloom.quality.rules import HAS_ROWS, INJECTION_RULES, RULES, matches, min_rows, not_null, unique
from ledgerloom.sources.lake import Lake, lake_for
from ledgerloom.sources.store import LayerStore
from tests.conftest import SMALL
from tests.test_plans import plan

TODAY = date(2001, 8, 1)


def results(df, *rules):
    return {r.rule_name: r for r in evaluate(df, "d", "t", rules, TODAY).collect()}


def test_null_fails_unless_ignored(spark):
    df = spark.createDataFrame([("A1",), ("bad!",), (None,)], "c string")
    got = results(df, matches("c", "^[A-Z0-9]+$", "strict"), matches("c", "^[A-Z0-9]+$", "lenient", ignore_null=True))
    assert (got["strict"].rows_failed, got["lenient"].rows_failed) == (2, 1)
    assert not got["strict"].passed


def test_uniqueness_counts_the_excess_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "k int")
    assert results(df, unique("k", "u"))["u"].rows_failed == 2


def test_table_rules_and_empty_tables(spark):
    df = spark.createDataFrame([(1,)], "k int")
    assert results(df, HAS_ROWS)["has-rows"].passed
    assert not results(df, min_rows(2, "m"))["m"].passed
    assert not results(df.limit(0), HAS_ROWS)["has-rows"].passed
    assert results(df.limit(0), not_null("k", "n"))["n"].passed


def test_thirty_one_declared_rules():
    assert sum(len(r) for r in RULES.values()) == 31


@pytest.mark.parametrize(("table", "rule", "broken"), [
    ("loans", "fico-range", "true"), ("accounts", "balance-non-negative", "true"), ("accounts", "account-type-valid", "account_type is null"),
    ("securities", "cusip-format", "true"), ("credit_cards", "apr-range", "true"), ("wire_transfers", "structuring-amount", "true")])
def test_injected_rows_raise_exactly_the_expected_failures(lake, table, rule, broken):
    rows = injected_rows(lake, table)
    failures = rows.where(broken).count()
    assert 0 < failures < lake.bronze(table).count()
    bad = {r.rule_name: r.rows_failed for r in evaluate(
        align(rows, lake.bronze(table)), "d", "t", INJECTION_RULES[table], TODAY).collect()}
    assert bad[rule] == failures
    delta = {(r.table_name, r.rule_name): r.new_failures for r in rerun_delta(lake).collect()}
    assert delta[(f"bronze_{table}", rule)] == failures


def test_quarantine_splits_without_loss(lake):
    frame = dirty(lake, "loans")
    good, bad = quarantine(frame, INJECTION_RULES["loans"], TODAY)
    assert bad.count() == injected_rows(lake, "loans").count() > 0
    assert good.count() + bad.count() == frame.count()
    assert bad.where(F.size("failed_rules") == 0).isEmpty()


def test_profile_modes(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else None) for i in range(1000)], "n bigint, s string")
    exact = {r.column_name: r for r in profile(df, sample=None, exact=True).collect()}
    assert exact["n"].distinct_count == 1000 and exact["s"].distinct_count == 1
    assert exact["s"].null_ratio == 0.5 and exact["n"].mean == 499.5
    sketch = {r.column_name: r for r in profile(df).collect()}
    assert 150 < sketch["n"].row_count < 350
    assert profile(df).first() == profile(df).first()


def test_summary_finds_the_first_unique_id(spark):
    rows = [(None if i == 0 else i, i % 3, f"k{i}", i) for i in range(10)]
    df = spark.createDataFrame(rows, "null_id int, twice_id int, key_id string, late_id int")
    tables = {"silver_t": df, "silver_empty": df.limit(0), "gold_x": df.select(F.col("late_id").alias("n"))}
    counts = spark.createDataFrame([("silver_t", 10), ("silver_empty", 0), ("gold_x", 10)], "table_name string, row_count long")
    got = {tuple(r) for r in summaries(tables, counts).collect()}
    assert got == {("silver", "silver_t", 10, 4, "key_id"), ("silver", "silver_empty", 0, 4, None), ("gold", "gold_x", 10, 1, None)}


def test_sketches_merge_to_the_exact_profile(spark):
    rows = [(i, i % 7 if i % 5 else None, f"k{i % 11}" if i % 3 else "") for i in range(3000)]
    df = spark.createDataFrame(rows, "n bigint, few int, s string").repartition(9)
    sketches = column_sketches(df, "d", "t").unionByName(column_sketches(df.limit(0), "d", "t"))
    assert sketches.count() == 27
    got = {r.column_name: r for r in merged_profile(sketches).collect()}
    n, few, s = got["n"], got["few"], got["s"]
    assert (n.row_count, n.null_count, n.distinct_count, n.min_number, n.max_number, n.mean) == (3000, 0, 3000, 0.0, 2999.0, 1499.5)
    assert (n.q1, n.median, n.q3) == (749.0, 1499.0, 2249.0)
    values = sorted(f for _, f, _ in rows if f is not None)
    assert (few.null_count, few.distinct_count, few.median) == (600, 7, values[(len(values) + 1) // 2 - 1])
    assert (s.distinct_count, s.min_text, s.max_text, s.median, s.mean) == (12, "", "k9", None, None)


def test_tables_in_the_rows_of_one_frame_have_the_profiles_of_their_own(spark):
    rows = [(f"T{i}" if i % 9 else None, f"A{i % 4}" if i % 5 else None, i if i % 7 else -i) for i in range(400)]
    bronze = spark.createDataFrame(rows, "transaction_id string, account_id string, amount int").selectExpr(
        "transaction_id", "account_id", "cast(amount / 8 as decimal(18,2)) as amount", "timestamp_ntz'2020-01-01' as created_at").repartition(3)
    now = datetime(2001, 8, 1)
    frame, mark, places = beside("transactions", bronze, now)
    silver = refine("transactions", bronze, now)
    assert list(places) == silver.columns and 0 < silver.count() < 400
    parts = [Part("d", "all", {c: c for c in bronze.columns}), Part("d", "kept", places, mark)]
    for part in (lambda df: df, portable_sample):
        got = merged_profile(part_sketches(part(frame), parts))
        alone = merged_profile(column_sketches(part(bronze), "d", "all").unionByName(column_sketches(part(silver), "d", "kept")))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, alone.collect()), key=repr)
    assert part_sketches(frame.where("amount < 0 and not _passes"), parts).select("table_name").distinct().collect() == [("all",)]


def test_sketches_take_texts_of_every_type(spark):
    df = spark.sql("""select * from values (date'0900-01-01', -0.0D, true, '', 1.50BD), (date'+10000-01-01', 0.0D, null, 'a', 1.50BD),
        (null, 0.0D, false, null, -2.25BD) as t(day, number, flag, label, money)""")
    got = {r.column_name: r for r in merged_profile(column_sketches(df, "d", "t")).collect()}
    for f in df.schema:
        texts = [str(r[0]) for r in df.select(F.col(f.name).cast("string")).where(F.col(f.name).isNotNull()).collect()]
        row = got[f.name]
        assert (row.distinct_count, row.null_count) == (len(set(texts)), 3 - len(texts))
        if f.name in ("day", "flag", "label"):
            assert (row.min_text, row.max_text) == (min(texts), max(texts))
    assert (got["number"].distinct_count, got["money"].min_number, got["money"].mean) == (2, -2.25, 0.25)


@pytest.mark.parametrize("query", [profile_all, profile_sampled])
def test_silver_that_takes_bronze_rows_one_by_one_is_sketched_with_bronze(spark, monkeypatch, query):
    module, alone, together = sys.modules[query.__module__], [], []
    found = spark.createDataFrame([("t",)], "table_name string")
    monkeypatch.setattr(LayerStore, "_read_or_write", lambda self, name, build: build())
    monkeypatch.setattr(module, "merged_profile", lambda sketches: sketches)
    monkeypatch.setattr(module, "column_sketches", lambda df, dataset, table: alone.append(table) or found)
    monkeypatch.setattr(module, "part_sketches", lambda df, parts: together.append([p.table for p in parts]) or found)
    lake = Lake(spark, SMALL)
    lake.pin("silver_trades", lake("silver_trades"))
    query(lake)
    pairs = {n for n, spec in SILVER.items() if not spec.dedupe} - {"trades"}
    assert sorted(together) == sorted([f"bronze_{n}", f"silver_{n}"] for n in pairs)
    assert sorted(alone) == sorted(set(SCANNED) - {t for pair in together for t in pair})


def test_sketches_keep_to_their_error_bound(spark):
    """Beyond the exact range: distinct values within four standard deviations, quartiles within a tenth of a percent of ranks."""
    n = 400_000
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("x"))
    exact = df.agg(F.expr("percentile_disc(0.25) within group (order by x)"), F.count_distinct("x")).first()
    got = merged_profile(column_sketches(df, "d", "t")).first()
    assert abs(got.distinct_count - exact[1]) <= 4 / 256 * n
    rank = df.where(F.col("x") <= got.q1).count()
    assert abs(rank - n / 4) <= n / 1000 and got.row_count == n


def test_stored_layers_follow_the_landing_files(spark, tmp_path):
    for name in ("events", "customer", "orders", "lineitem", "supplier", "nation", "region"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    wanted = ["bronze_audit_events", "silver_fraud_alerts"]

    def counts():
        return {r.table_name: r.row_count for r in lake_for(spark, str(tmp_path)).stored.row_counts(wanted).collect()}

    before, store = counts(), lake_for(spark, str(tmp_path)).stored
    entry = store.files.read(f"{store.root}/bronze_audit_events.json")
    assert counts() == before and store is lake_for(spark, str(tmp_path)).stored
    assert store.files.read(f"{store.root}/bronze_audit_events.json") == entry  # written once
    spark.read.parquet(f"{SMALL}/events.parquet").limit(100).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert counts()["bronze_audit_events"] == 100 < before["bronze_audit_events"]
    assert store.root != lake_for(spark, str(tmp_path)).stored.root


def test_rules_and_dates_of_whole_layers_write_no_layers(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a layer was stored")

    monkeypatch.setattr(LayerStore, "keep", refuse)
    lake = Lake(spark, SMALL)
    counts = {r.table_name: r.rows_evaluated for r in all_results(lake).collect() if r.rule_name == "has-rows"}
    assert set(counts) == set(SCANNED) - set(RULES)
    for table in ("bronze_holdings", "silver_portfolios", "silver_fee_schedules", "silver_employees", "gold_aml_risk_scoring"):
        assert counts[table] == lake(table).count()
    assert retention_due(lake).count() == 40 and freshness_check(lake).count() == 23


def test_profiles_and_leak_scan_write_sketches_at_most(spark, monkeypatch):
    written = []
    monkeypatch.setattr(LayerStore, "keep", lambda self, name, build: written.append(name) or build())
    lake = Lake(spark, SMALL)
    profile_all(lake)
    assert len(written) == len(SCANNED) and all(n.startswith("sketches-") for n in written)
    written.clear()
    pii_leak_scan(lake)
    assert written == []


def test_keys_are_sought_in_later_columns_only_where_needed(spark, monkeypatch):
    asked = []
    module = sys.modules[summaries.__module__]
    plain = module.text_values
    monkeypatch.setattr(module, "text_values", lambda tables, wanted: asked.append(dict(wanted)) or plain(tables, wanted))
    df = spark.createDataFrame([(i, i // 2, i) for i in range(4)], "a_id int, b_id int, c_id int")
    tables = {"silver_first": df, "silver_later": df.select("b_id", "c_id", "a_id")}
    counts = spark.createDataFrame([(t, 4) for t in tables], "table_name string, row_count long")
    assert {r.table_name: r.pk_column for r in summaries(tables, counts).collect()} == {"silver_first": "a_id", "silver_later": "c_id"}
    assert asked == [{"silver_first": ["a_id"], "silver_later": ["b_id"]}, {"silver_later": ["c_id"]}]


def test_keys_are_sought_by_hash_and_chance_is_told_from_repeats(spark, monkeypatch):
    module, grouped = sys.modules[summaries.__module__], []
    plain = module._repeats
    monkeypatch.setattr(module, "_repeats", lambda values, by: grouped.append("xxhash64" in str(by)) or plain(values, by))
    rows = spark.range(200)
    same = spark.createDataFrame([("1",), ("1",), ("2",)], "a_id string")
    monkeypatch.setattr(F, "xxhash64", lambda c: F.expr(f"if({c} in ('7', '8'), 1L, xxhash64({c}))"))  # two that agree by chance
    tables = {"silver_chance": rows.selectExpr("id as a_id"), "silver_few": same, "silver_many": rows.selectExpr("id % 9 as a_id")}
    got = {r.table_name: (r.row_count, r.pk_column) for r in summaries(tables, None).collect()}
    assert got == {"silver_chance": (200, "a_id"), "silver_few": (3, None), "silver_many": (200, None)}
    assert grouped == [True, False]


def test_row_counts_read_footers_only(spark, lake):
    lake.stored.tables(["silver_loans", "silver_branches"])
    text = plan(lake.stored.footers(["silver_loans", "silver_branches"]))
    assert "PushedAggregation: [COUNT(*)]" in text and text.count("BatchScan parquet file") <= 2
    got = {r.table_name: r.row_count for r in lake.stored.row_counts(["silver_loans", "silver_branches"]).collect()}
    assert got == {t: lake(t).count() for t in got}
