"""Regulatory schedules per quarter, rolled up from the ledger, the loan book and regulatory capital."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import or_zero, quarter_end, ratio, ts_lit
from ledgerloom.plans.reference import posted_lines
from ledgerloom.sources.lake import Lake

DEBIT_NORMAL = ("Asset", "Expense")

# Schedule line and description of each loan product.
LOAN_LINES = {
    "HELOC": ("RC-C-1", "Loans Secured by RE"),
    "MORTGAGE": ("RC-C-2", "1-4 Family Residential"),
    "COMMERCIAL": ("RC-C-5", "C&I Loans"),
    "PERSONAL": ("RC-C-6", "Consumer Loans"),
    "CREDIT_CARD": ("RC-C-7", "Credit Cards"),
    "AUTO": ("RC-C-8", "Auto Loans"),
    "SBA": ("RC-C-11", "Other Loans"),
}
# Consolidated line, its description, and the schedule lines it adds up.
CONSOLIDATED = (
    ("Y9C-HC-B1", "Consolidated Assets", ("RC-B1", "RC-B2", "RC-C1", "RC-C2", "RC-6", "RC-11")),
    ("Y9C-HC-B2", "Securities", ("RC-B2",)),
    ("Y9C-HC-C1", "Loans", ("RC-C-12",)),
    ("Y9C-HC-E", "Deposits", ("RC-E1", "RC-E2")),
    ("Y9C-HC-R1", "Risk-Weighted Assets", ("RC-R-1",)),
    ("Y9C-HC-R2", "Total Capital", ("RC-R-4",)),
    ("Y9C-HI-1", "Interest Income", ("RI-1",)),
    ("Y9C-HI-2", "Interest Expense", ("RI-2",)),
    ("Y9C-HI-7", "Noninterest Expense", ("RI-7",)),
    ("Y9C-HC-28", "Total Equity", ("RC-26", "RC-26a")),
)


def _filed(lake: Lake, df: DataFrame, amount: Column) -> DataFrame:
    return df.select(
        "reporting_date", "schedule_line", "line_description", amount.cast("double").alias("amount"),
        F.lit("Filed").alias("status"), ts_lit(lake.clock.book).alias("created_at"))


def _ledger_lines(lake: Lake, schedules: tuple[str, ...]) -> DataFrame:
    """Net postings per quarter and line, signed by the normal balance of the account type."""
    line = F.col("call_report_line")
    wanted = line.startswith(schedules[0])
    for prefix in schedules[1:]:
        wanted = wanted | line.startswith(prefix)
    lines = posted_lines(lake, quarter_end("posting_date").alias("reporting_date")).where(wanted)
    debit, credit = or_zero("debits"), or_zero("credits")
    net = F.when(F.col("l1_type").isin(*DEBIT_NORMAL), debit - credit).otherwise(credit - debit)
    grouped = lines.groupBy(
        "reporting_date", line.alias("schedule_line"), F.col("l2_category").alias("line_description")
    ).agg(F.sum(net).alias("net"))
    return _filed(lake, grouped, F.round("net", 0))


def call_report_rc(lake: Lake) -> DataFrame:
    return _ledger_lines(lake, ("RC-",))


def call_report_ri(lake: Lake) -> DataFrame:
    return _ledger_lines(lake, ("RI-",))


def call_report_rc_r(lake: Lake) -> DataFrame:
    """Capital schedule: one pass over the components of a quarter, then one row per line."""
    component, amount = F.col("capital_component"), F.col("capital_amount")

    def of(name: str) -> Column:
        return F.sum(F.when(component == name, amount))

    wide = lake.silver("regulatory_capital").groupBy("reporting_date").agg(
        F.max("risk_weighted_assets").alias("rwa"), of("CET1").alias("cet1"),
        (of("CET1") + of("Additional Tier 1")).alias("tier1"), of("Total Capital").alias("total"),
        F.max("leverage_exposure").alias("exposure"))

    def line(n: int, text: str, value: Column) -> Column:
        return F.struct(F.lit(f"RC-R-{n}").alias("schedule_line"), F.lit(text).alias("line_description"),
                        value.cast("double").alias("value"))

    long = wide.select("reporting_date", F.inline(F.array(
        line(1, "Total RWA", F.round("rwa", 0)),
        line(2, "CET1 Capital", F.round("cet1", 0)),
        line(3, "Tier 1 Capital", F.round("tier1", 0)),
        line(4, "Total Capital", F.round("total", 0)),
        line(5, "CET1 Ratio", ratio("cet1", "rwa", 4)),
        line(6, "Tier 1 Ratio", ratio("tier1", "rwa", 4)),
        line(7, "Total Capital Ratio", ratio("total", "rwa", 4)),
        line(8, "Leverage Ratio", ratio("tier1", "exposure", 4)),
    )))
    return _filed(lake, long, F.col("value"))


def call_report_rc_c(lake: Lake) -> DataFrame:
    """Loans and cards by category and origination quarter, with a total line per quarter."""
    loans = lake.silver("loans").groupBy(
        quarter_end("origination_date").alias("reporting_date"), F.col("loan_type").alias("kind")
    ).agg(F.sum("current_balance").alias("balance"))
    cards = lake.silver("credit_cards").groupBy(
        quarter_end("issue_date").alias("reporting_date"), F.lit("CREDIT_CARD").alias("kind")
    ).agg(F.sum("current_balance").alias("balance"))
    kind = F.col("kind")
    line = text = None
    for k, (code, label) in LOAN_LINES.items():
        line = F.when(kind == k, code) if line is None else line.when(kind == k, code)
        text = F.when(kind == k, label) if text is None else text.when(kind == k, label)
    parts = loans.unionByName(cards).select(
        "reporting_date", line.alias("schedule_line"), text.alias("line_description"), "balance")
    # The total repeats every part under the total line; parts are already one row per quarter and kind.
    lines = parts.select("reporting_date", "balance", F.inline(F.array(
        F.struct("schedule_line", "line_description"),
        F.struct(F.lit("RC-C-12").alias("schedule_line"), F.lit("Total Loans and Leases").alias("line_description")),
    )))
    summed = lines.groupBy("reporting_date", "schedule_line", "line_description").agg(F.sum("balance").alias("balance"))
    return _filed(lake, summed, F.round("balance", 0))


def fr_y9c(lake: Lake) -> DataFrame:
    """Consolidated statement: the lines of the other schedules under their consolidated codes."""
    ledger = _ledger_lines(lake, ("RC-", "RI-"))  # one pass over the postings for both schedules
    schedules = ledger.unionByName(call_report_rc_r(lake)).unionByName(call_report_rc_c(lake))
    line = F.col("schedule_line")
    codes = F.array_compact(F.array(*[
        F.when(line.isin(*parts), F.struct(F.lit(code).alias("schedule_line"), F.lit(text).alias("line_description")))
        for code, text, parts in CONSOLIDATED]))
    mapped = schedules.select("reporting_date", "amount", F.inline(codes))
    # Amounts are whole units, so the decimal sum is exact.
    summed = mapped.groupBy("reporting_date", "schedule_line", "line_description").agg(
        F.sum(F.col("amount").cast("decimal(28,0)")).alias("amount"))
    return _filed(lake, summed, F.col("amount")).withColumn("regulatory_body", F.lit("Federal Reserve"))


STAGING = {
    "staging_call_report_rc": call_report_rc,
    "staging_call_report_ri": call_report_ri,
    "staging_call_report_rc_r": call_report_rc_r,
    "staging_call_report_rc_c": call_report_rc_c,
    "staging_fr_y9c": fr_y9c,
}
