"""Data-quality queries: results, scorecards, templates, injections, profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import count_where, mean, or_zero, round_to, safe_div
from ledgerloom.plans.gold import GOLD
from ledgerloom.plans.silver import SILVER, beside
from ledgerloom.quality import templates as t
from ledgerloom.quality.engine import compare_runs, evaluate, quarantine
from ledgerloom.quality.profile import SKETCH_TASKS, Part, column_sketches, merged_profile, part_sketches, portable_sample, profile, summaries
from ledgerloom.quality.rules import ACCOUNT_ID, CUSIP, HAS_ROWS, INJECTION_RULES, ISIN, MASKED_SSN, RULES
from ledgerloom.sources.bindings import BINDINGS, INJECTIONS
from ledgerloom.sources.lake import Lake

SCANNED = tuple(
    [f"bronze_{n}" for n in BINDINGS] + [f"silver_{n}" for n in SILVER] + [f"gold_{n}" for n in GOLD])


def dataset_of(table: str) -> str:
    return table.partition("_")[0]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def rule_results(lake: Lake) -> DataFrame:
    """Every declared rule against its table, one aggregate pass per table, which is planned and not stored."""
    return union_all([
        evaluate(lake.undealt(table), dataset_of(table), table, rules, lake.clock.book_day) for table, rules in RULES.items()])


def counted_rows(lake: Lake, table: str) -> DataFrame:
    """As many rows as the table has. Where the newest row of each key is kept unconditionally, those are its keys."""
    layer, _, name = table.partition("_")
    spec = SILVER.get(name)
    if layer == "silver" and table not in lake.pinned and spec.dedupe and not spec.required and spec.where is None:
        return lake(f"bronze_{name}").select(spec.key).where(F.col(spec.key).isNotNull()).distinct()
    return lake(table)


def row_counts(lake: Lake, tables: Iterable[str]) -> DataFrame:
    """(table_name, row_count) of every named table, counted over its plan: columns that decide no row are never read."""
    plans = lake.undealt
    return union_all([
        counted_rows(plans, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t in tables])


def volume_results(lake: Lake) -> DataFrame:
    """The default rule of every table without rules of its own: it must have rows."""
    counts = row_counts(lake, [t for t in SCANNED if t not in RULES])
    n, rule = F.col("row_count"), HAS_ROWS
    return counts.select(
        F.element_at(F.split("table_name", "_"), 1).alias("dataset"), "table_name", F.lit(rule.name).alias("rule_name"),
        F.lit(rule.dimension).alias("dimension"), F.lit(rule.column).cast("string").alias("column_name"),
        round_to(safe_div(n, n) * 100, 4).alias("pass_rate"), n.alias("rows_evaluated"), F.lit(0).cast("bigint").alias("rows_failed"),
        F.lit(float(rule.threshold)).alias("threshold"), (n > 0).alias("passed"), F.lit(rule.term).cast("string").alias("term"))


def all_results(lake: Lake) -> DataFrame:
    """Declared and volume rules of every table, one row per rule."""
    return rule_results(lake).unionByName(volume_results(lake))


def scorecard(lake: Lake) -> DataFrame:
    return all_results(lake).groupBy("dataset", "table_name", "dimension").agg(mean("pass_rate", 2).alias("score"))


def by_dimension(lake: Lake) -> DataFrame:
    return all_results(lake).groupBy("dimension").agg(
        mean("pass_rate", 2).alias("avg_score"), F.count(F.lit(1)).alias("rule_count"))


def failed_rules(lake: Lake) -> DataFrame:
    return all_results(lake).where(~F.col("passed")).select(
        "dataset", "table_name", "rule_name", "dimension", "pass_rate")


def rule_detail(lake: Lake) -> DataFrame:
    return all_results(lake).select(
        "dataset", "table_name", "rule_name", "dimension", "column_name", "pass_rate", "rows_evaluated", "rows_failed")


def by_term(lake: Lake) -> DataFrame:
    """Trust in a business term: results of the rules attached to it, injected rows included.

    Tables with injected rows are judged with them; other tables with a rule for a term as they are.
    """
    others = [t for t, rules in RULES.items() if any(r.term for r in rules) and t not in {f"bronze_{i}" for i in INJECTIONS}]
    results = union_all(
        [_dirty_results(lake, table) for table in INJECTIONS]
        + [evaluate(lake(t), dataset_of(t), t, RULES[t], lake.clock.book_day) for t in others])
    return results.where(F.col("term").isNotNull()).groupBy("term").agg(
        F.count(F.lit(1)).alias("rules"), F.sum("rows_evaluated").alias("rows_evaluated"),
        F.sum("rows_failed").alias("rows_failed"), F.min("pass_rate").alias("worst_pass_rate"))


def profile_summary(lake: Lake) -> DataFrame:
    """Size and key of every scanned table. Where silver keeps a row of each key whatever is in it, its keys are those of bronze."""
    plans = lake.undealt
    tables = {t: plans(t) for t in SCANNED}
    without = [t for t, df in tables.items() if not any(c.endswith("_id") for c in df.columns)]
    lean = {t: counted_rows(plans, t) for t in SCANNED if t.startswith("silver_")}
    return summaries(tables, row_counts(lake, without) if without else None, lean)


def _sketched(lake: Lake, name: str, part: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sketches of every column of every scanned table, stored and read as one; the tables are planned and not stored.

    A bronze table and the silver table that keeps or drops each of its rows by itself are sketched in one pass over bronze.
    `part` takes rows by the first column, which such a silver table has from bronze unchanged.
    """
    plans, store = lake.undealt, lake.stored
    passes: dict[str, Callable[[], DataFrame]] = {}
    shared: list[str] = []

    def both(table: str) -> Callable[[], DataFrame] | None:
        bronze, silver = f"bronze_{table}", f"silver_{table}"
        found = None if {bronze, silver} & set(lake.pinned) else beside(table, plans(bronze), lake.now_of(table))
        if found is None:
            return None
        frame, mark, places = found
        columns = {c: c for c in plans(bronze).columns}
        if places.get(first := frame.columns[0]) != first:
            return None
        return lambda: part_sketches(part(frame).coalesce(SKETCH_TASKS), [
            Part("bronze", bronze, columns), Part("silver", silver, places, mark)])

    for t in SCANNED:
        layer, _, table = t.partition("_")
        if layer == "bronze" and (build := both(table)):
            passes[t] = build
            shared.append(table)
        elif not (layer == "silver" and table in shared):
            passes[t] = lambda t=t: column_sketches(part(plans(t)).coalesce(SKETCH_TASKS), dataset_of(t), t)
    kept = store.keep_all({f"{name}-{t}": build for t, build in passes.items()})
    of = F.col("table_name")
    return union_all([kept[f"{name}-{t}"].where(of == t) for t in passes] + [
        store.keep(f"{name}-bronze_{t}", passes[f"bronze_{t}"]).where(of == f"silver_{t}") for t in shared])


def profile_all(lake: Lake) -> DataFrame:
    """One row per column of every scanned table."""
    return merged_profile(_sketched(lake, "sketches", lambda df: df))


def profile_sampled(lake: Lake) -> DataFrame:
    """The same over a quarter of each table."""
    return merged_profile(_sketched(lake, "sampled", portable_sample))


# ---- injected rows ------------------------------------------------------------------------------


def injected_rows(lake: Lake, table: str) -> DataFrame:
    """Copies of some rows of a bronze table with bad values in them."""
    spec = INJECTIONS[table]
    # All bad values are made from the row as it was, so the key is replaced together with them.
    return lake.bronze(table).where(F.expr(spec.chosen)).withColumns({c: F.expr(e) for c, e in spec.values.items()})


def dirty(lake: Lake, table: str) -> DataFrame:
    """The bronze table with its bad rows appended, in one pass: a chosen row stands there twice, as it was and spoilt.

    The table is read, and joined where its binding joins, once; columns that nobody asks for are not computed.
    """
    spec, rows = INJECTIONS[table], lake.bronze(table)
    unknown = [c for c in spec.values if c not in rows.columns]
    if unknown:
        raise ValueError(f"columns not in the target table: {unknown}")
    spoilt = F.explode(F.when(F.expr(spec.chosen), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    return rows.withColumn("_spoilt", spoilt).select([
        F.when(F.col("_spoilt"), F.expr(spec.values[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
        if f.name in spec.values else F.col(f.name) for f in rows.schema])


def _results(lake: Lake, table: str, frame: DataFrame) -> DataFrame:
    return evaluate(frame, "bronze", f"bronze_{table}", INJECTION_RULES[table], lake.clock.book_day)


def _dirty_results(lake: Lake, table: str) -> DataFrame:
    return _results(lake, table, dirty(lake, table))


def rerun_delta(lake: Lake) -> DataFrame:
    before = union_all([_results(lake, table, lake.bronze(table)) for table in INJECTIONS])
    after = union_all([_dirty_results(lake, table) for table in INJECTIONS])
    return compare_runs(before, after)


def trust_statement(lake: Lake) -> DataFrame:
    """Average FICO score, and how far the rows behind it can be trusted."""
    score = F.col("fico_score_at_origination")
    valid = F.coalesce(score.between(300, 850), F.lit(False))
    measured = dirty(lake, "loans").agg(
        F.sum(score).alias("s"), F.count(score).alias("n"), F.sum(F.when(valid, score)).alias("vs"),
        count_where(valid).alias("valid_rows"), F.count(F.lit(1)).alias("rows_evaluated"))
    rate = safe_div("valid_rows", "rows_evaluated")
    return measured.select(
        F.lit("avg_fico").alias("metric"), round_to(safe_div("s", "n"), 2).alias("metric_value"),
        round_to(safe_div("vs", "valid_rows"), 2).alias("value_on_valid_rows"), "rows_evaluated",
        (F.col("rows_evaluated") - F.col("valid_rows")).alias("rows_failed"),
        round_to(rate * 100, 4).alias("pass_rate"),
        F.when(rate >= 1.0, "Trusted").when(rate >= 0.95, "Usable with care").otherwise("Do not use").alias("verdict"))


def quarantined_loans(lake: Lake) -> DataFrame:
    _, bad = quarantine(dirty(lake, "loans"), INJECTION_RULES["loans"], lake.clock.book_day)
    return bad.select(
        "loan_id", "fico_score_at_origination", "risk_rating", F.array_join("failed_rules", ",").alias("failed_rules"),
        F.size("failed_rules").cast("bigint").alias("n_failed"))


def recon_breaks(lake: Lake) -> DataFrame:
    return lake.silver("custodian_feeds").groupBy("custodian_name", "reconciliation_status").agg(
        F.count(F.lit(1)).alias("feeds"), count_where(F.col("has_break")).alias("breaks"),
        F.sum("break_amount").alias("net_break"),
        or_zero(F.sum(F.when(F.col("has_break"), F.abs("break_amount")))).alias("gross_break"),
        F.max(F.abs("break_amount")).alias("largest_break"))


def profiled_loans(lake: Lake) -> DataFrame:
    """Exact profile of the whole loan table."""
    columns = ("loan_id", "loan_type", "original_amount", "current_balance", "interest_rate", "ltv_ratio",
               "fico_score_at_origination", "origination_date", "risk_rating", "collateral_description")
    found = profile(lake.silver("loans").select(*columns), sample=None, exact=True, accuracy=100_000)
    return found.drop("position")


QUALITY = {
    "dq_rule_results": rule_results,
    "dq_volume_rules": volume_results,
    "dq_scorecard": scorecard,
    "vw_dq_scorecard": scorecard,
    "vw_dq_by_dimension": by_dimension,
    "vw_dq_failed_rules": failed_rules,
    "vw_dq_rule_detail": rule_detail,
    "vw_profile_summary": profile_summary,
    "dq_by_term": by_term,
    **{f"dirty_{label}": (lambda lake, n=table: _dirty_results(lake, n)) for label, table in (
        ("loans", "loans"), ("accounts", "accounts"), ("customers", "customers"), ("securities", "securities"),
        ("cards", "credit_cards"), ("wires", "wire_transfers"))},
    "dq_rerun_delta": rerun_delta,
    "dq_trust_statement": trust_statement,
    "dq_quarantine": quarantined_loans,
    "recon_breaks": recon_breaks,
    "profile": profile_all,
    "profile_sampled": profile_sampled,
    "profile_exact_loans": profiled_loans,
    "dq_cusip_format": lambda lake: t.breaks_format(dirty(lake, "securities"), "cusip", CUSIP).select(
        "security_id", "cusip"),
    "dq_isin_format": lambda lake: t.breaks_format(dirty(lake, "securities"), "isin", ISIN).select(
        "security_id", "isin"),
    "dq_masked_ssn": lambda lake: t.breaks_format(lake.silver("customers"), "ssn_masked", MASKED_SSN).select(
        "customer_id", "ssn_masked").unionByName(
            t.breaks_format(dirty(lake, "customers"), "ssn", MASKED_SSN).select(
                "customer_id", F.col("ssn").alias("ssn_masked"))),
    "dq_account_id_format": lambda lake: t.breaks_format(dirty(lake, "accounts"), "account_id", ACCOUNT_ID).select(
        "account_id", "customer_id"),
    "dq_balance_non_negative": lambda lake: t.negative(dirty(lake, "accounts"), "current_balance").select(
        "account_id", "current_balance"),
    "dq_interest_rate_range": lambda lake: t.rate_out_of_range(dirty(lake, "credit_cards"), "apr").select(
        "card_id", "apr"),
    "dq_fico_range": lambda lake: t.fico_out_of_range(dirty(lake, "loans"), "fico_score_at_origination").select(
        "loan_id", "fico_score_at_origination"),
    "dq_date_not_future": lambda lake: t.in_future(
        lake.silver("kyc_records"), "next_review_date", lake.clock.book_day).select("kyc_id", "next_review_date"),
    "dq_date_ordering": lambda lake: t.out_of_order(lake.silver("fraud_alerts"), "alert_date", "resolved_date").select(
        "alert_id", "alert_date", "resolved_date"),
    "dq_foreign_key": lambda lake: t.orphans(
        lake.silver("loans"), "originating_branch_id",
        lake.silver("branches").where(F.col("status") == "Open"), "branch_id").select(
            "loan_id", "originating_branch_id"),
}
