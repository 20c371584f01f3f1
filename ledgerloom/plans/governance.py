"""Governance queries: masking, hierarchies and lineage, retention, freshness, leak scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.scalars import count_where, day_lit, is_true, minutes_between, ts_lit
from ledgerloom.operators.closure import closure
from ledgerloom.operators.policy import apply_policy
from ledgerloom.plans.silver import SILVER
from ledgerloom.sources.bindings import BINDINGS
from ledgerloom.sources.lake import Lake

# Silver inputs of every gold table; lineage and freshness are derived from it.
GOLD_INPUTS: dict[str, tuple[str, ...]] = {
    "customer_360": ("customers", "accounts", "loans", "credit_cards", "wm_clients"),
    "account_summary": ("accounts", "transactions"),
    "transaction_patterns": ("transactions",),
    "loan_portfolio_summary": ("loans",),
    "delinquency_analysis": ("loans",),
    "fraud_analytics": ("fraud_alerts",),
    "aml_risk_scoring": ("customers", "kyc_records", "compliance_cases", "wire_transfers"),
    "branch_performance": ("branches", "accounts", "loans", "transactions"),
    "portfolio_performance": ("portfolios", "performance", "holdings", "benchmarks"),
    "client_revenue": ("wm_clients", "fee_schedules", "portfolios", "trades"),
    "asset_allocation": ("holdings",),
    "advisor_scorecard": ("advisors", "portfolios", "performance", "trades"),
    "fee_revenue": ("fee_schedules", "wm_clients"),
    "net_interest_margin": ("accounts", "loans"),
    "capital_adequacy": ("regulatory_capital",),
    "liquidity_coverage": ("accounts", "securities", "holdings"),
    "market_risk_var": ("holdings", "market_data"),
    "operational_risk": ("audit_events", "compliance_cases"),
    "regulatory_dashboard": ("regulatory_capital", "kyc_records", "regulatory_filings"),
    "balance_sheet_summary": ("accounts", "loans", "holdings", "regulatory_capital"),
}

# Data products, the minutes between refreshes, the allowed delay in minutes, and their assets.
DAY_MINUTES = 1440
PRODUCTS = (
    ("Customer Intelligence 360", DAY_MINUTES, 30,
     ("silver_customers", "silver_wm_clients", "silver_kyc_records", "gold_customer_360", "gold_aml_risk_scoring")),
    ("Lending & Credit Risk", DAY_MINUTES, 60,
     ("silver_loans", "silver_loan_payments", "gold_loan_portfolio_summary", "gold_delinquency_analysis")),
    ("Wealth Management Analytics", DAY_MINUTES, 60,
     ("silver_portfolios", "silver_holdings", "gold_portfolio_performance", "gold_advisor_scorecard",
      "gold_client_revenue", "gold_asset_allocation")),
    ("Regulatory & Compliance", DAY_MINUTES, 120,
     ("gold_fraud_analytics", "gold_aml_risk_scoring", "gold_capital_adequacy", "gold_regulatory_dashboard")),
    ("Financial Performance", 31 * DAY_MINUTES, 300,
     ("gold_net_interest_margin", "gold_fee_revenue", "gold_branch_performance", "gold_balance_sheet_summary")),
)

# Words in table names that set the retention family, in years.
CREATION_FAMILY = ("fraud", "kyc", "compliance", "sar")
FISCAL_FAMILY = ("gl_", "capital", "stress", "regulatory")
LONG_YEARS, USUAL_YEARS = 7, 5
# The date of a table's rows: the one whose fiscal year counts, or the one that ended a relation or was its last
# activity. Tables that are not named record no end, so the period of their rows has not started.
ROW_DATES: dict[str, tuple[str, ...]] = {
    "ach_transfers": ("effective_date", "settlement_date"),
    "atm_transactions": ("transaction_date",),
    "audit_events": ("event_timestamp",),
    "benchmarks": ("as_of_date",),
    "card_transactions": ("transaction_date",),
    "client_goals": ("target_date",),
    "counterparties": ("last_review_date",),
    "credit_cards": ("expiration_date",),
    "custodian_feeds": ("as_of_date",),
    "distributions": ("distribution_date", "settlement_date"),
    "fee_schedules": ("end_date", "last_billing_date"),
    "fx_rates": ("as_of_date",),
    "gl_accounts": ("created_at",),
    "gl_entries": ("posting_date",),
    "holdings": ("as_of_date",),
    "interest_rates": ("as_of_date",),
    "loan_payments": ("payment_date",),
    "market_data": ("as_of_date",),
    "performance": ("as_of_date",),
    "regulatory_capital": ("reporting_date",),
    "regulatory_filings": ("reporting_period_end",),
    "risk_exposures": ("as_of_date",),
    "risk_profiles": ("assessment_date",),
    "securities": ("maturity_date",),
    "stress_tests": ("projection_quarter",),
    "trades": ("trade_date", "settlement_date"),
    "transactions": ("transaction_date",),
    "wire_transfers": ("initiation_date",),
}
# What unmasked personal data looks like.
LEAK_PATTERNS = {
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}
# A character that every match holds, and how often at least.
LEAK_MARKS = {"ssn": ("-", 2), "email": ("@", 1), "phone": ("(", 1)}
# Key of the registered queries' tokens; a deployment passes its own.
MASKING_KEY = "registered-query"
# Every silver and gold table.
LEAK_TABLES = (*(f"silver_{n}" for n in SILVER), *(f"gold_{n}" for n in GOLD_INPUTS))


def masked_customers(lake: Lake) -> DataFrame:
    """Customers as a reader without personal-data clearance sees them."""
    return apply_policy(lake.silver("customers"), "silver_customers", "internal", MASKING_KEY)


def masked_customer_360(lake: Lake) -> DataFrame:
    """Customer 360 for a reader who may see financial figures but no names."""
    return apply_policy(lake.gold("customer_360"), "gold_customer_360", "confidential", MASKING_KEY)


def employee_closure(lake: Lake) -> DataFrame:
    return closure(lake.silver("employees"), "employee_id", "manager_id")


def gl_account_closure(lake: Lake) -> DataFrame:
    return closure(lake.silver("gl_accounts"), "gl_account_id", "parent_account_id")


def lineage_edges(spark) -> DataFrame:
    """Table-level lineage: source to bronze, bronze to silver, silver to gold."""
    system = {name: b.columns["source_system"].strip("'") for name, b in BINDINGS.items()}
    rows = [(f"{system[n].lower()}.{n}", f"bronze_{n}", "ingest") for n in BINDINGS]
    rows += [(f"bronze_{n}", f"silver_{n}", "refine") for n in SILVER]
    rows += [(f"silver_{s}", f"gold_{g}", "aggregate") for g, inputs in GOLD_INPUTS.items() for s in inputs]
    return spark.createDataFrame(rows, "src string, dst string, process string")


def impact(spark, table: str) -> DataFrame:
    """Everything downstream of a table."""
    return closure(lineage_edges(spark), "dst", "src").where(F.col("ancestor") == table)


def retention_family(table: str) -> str:
    if any(word in table for word in CREATION_FAMILY):
        return "creation"
    return "fiscal" if any(word in table for word in FISCAL_FAMILY) else "activity"


def retention_years(table: str) -> int:
    return USUAL_YEARS if retention_family(table) == "activity" else LONG_YEARS


def _newest(columns: tuple[str, ...]) -> Column:
    dates = [F.col(c).cast("date") for c in columns]
    return F.greatest(*dates) if len(dates) > 1 else dates[0]


def retention_starts(lake, table: str) -> DataFrame:
    """The day on which the retention period of each row of a silver table starts; NULL while it has not.

    The period starts at the creation of the record, at the end of the fiscal year of the row, or at the end or last
    activity of the relation. An account runs until it is no longer active, then counts from its closure or last
    transaction; a loan counts from its maturity or last payment, whichever is later. `lake` gives tables by name.
    """
    rows = lake(f"silver_{table}")
    if retention_family(table) == "creation":
        return rows.select(F.col("created_at").cast("date").alias("start"))
    if retention_family(table) == "fiscal":
        return rows.select(F.make_date(F.year(_newest(ROW_DATES[table])), F.lit(12), F.lit(31)).alias("start"))
    if table == "accounts":
        moved = lake("silver_transactions").groupBy("account_id").agg(F.max(F.col("transaction_date").cast("date")).alias("moved"))
        return rows.join(moved, "account_id", "left").select(
            F.when(~is_true(F.col("account_status") == "Active"), _newest(("close_date", "moved"))).alias("start"))
    if table == "loans":
        paid = lake("silver_loan_payments").groupBy("loan_id").agg(F.max(F.col("payment_date").cast("date")).alias("paid"))
        return rows.join(paid, "loan_id", "left").select(_newest(("maturity_date", "paid")).alias("start"))
    if table in ROW_DATES:
        return rows.select(_newest(ROW_DATES[table]).alias("start"))
    return rows.select(F.lit(None).cast("date").alias("start"))


def retention_due(lake: Lake) -> DataFrame:
    """Rows past their retention period, for every silver table: one aggregate over all of them, nothing stored."""
    today = day_lit(lake.clock.book_day)
    starts = reduce(DataFrame.unionByName, [retention_starts(lake.undealt, t).select(
        F.lit(t).alias("table_name"), F.lit(retention_years(t)).alias("retention_years"), "start") for t in SILVER])
    found = starts.groupBy("table_name", "retention_years").agg(
        F.count(F.lit(1)).alias("rows_total"),
        count_where(F.add_months("start", 12 * F.col("retention_years")) < today).alias("rows_due"), F.min("start").alias("oldest"))
    listed = lake.spark.createDataFrame([(t, retention_years(t)) for t in SILVER], "table_name string, retention_years int")
    return listed.join(found, ["table_name", "retention_years"], "left").select(
        "table_name", "retention_years", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("rows_total", "rows_due")], "oldest")


def asset_sources() -> list[tuple[str, str, int, int, str]]:
    """(product, asset, refresh minutes, allowed delay, silver table it is loaded from)."""
    out = []
    for product, every, slack, assets in PRODUCTS:
        for asset in assets:
            layer, _, name = asset.partition("_")
            for source in (name,) if layer == "silver" else GOLD_INPUTS[name]:
                out.append((product, asset, every, slack, source))
    return out


def freshness_check(lake: Lake) -> DataFrame:
    """Whether every asset of every data product was loaded within its contract.

    An asset is as old as the stalest of the tables behind it. One that was never
    loaded has no age, so the asset has none either and is not fresh.
    """
    assets = asset_sources()
    sources = list(dict.fromkeys(a[4] for a in assets))
    # Loads stamped after the run's clock are late arrivals of the fixture, not fresher data.
    loads = reduce(DataFrame.unionByName, [lake.undealt(f"bronze_{s}").select(
        F.lit(s).alias("source"), ts_lit(lake.now_of(s)).alias("now"),
        F.when(F.col("created_at") <= ts_lit(lake.now_of(s)), F.col("created_at")).alias("loaded_at")) for s in sources])
    found = loads.groupBy("source", "now").agg(F.max("loaded_at").alias("loaded_at"))
    listed = lake.spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("source"), ts_lit(lake.now_of(s)).alias("now")) for s in sources])))
    newest = listed.join(found, ["source", "now"], "left")
    contract = lake.spark.createDataFrame(
        assets, "product string, asset string, every int, slack int, source string")
    age = minutes_between("loaded_at", "now")
    limit = F.col("every") + F.col("slack")
    return (
        newest.join(F.broadcast(contract), "source")  # a few dozen literal rows
        .groupBy("product", "asset")
        .agg(F.when(F.count("loaded_at") == F.count(F.lit(1)), F.max(age)).alias("age_minutes"), F.max(limit.cast("bigint")).alias("limit_minutes"),
             F.min("loaded_at").alias("loaded_at"))
        .withColumn("fresh", is_true(F.col("age_minutes") <= F.col("limit_minutes")))
    )


def pii_leak_scan(lake: Lake) -> DataFrame:
    """Count of values that look like unmasked personal data, per table, column and pattern.

    Every text column of every silver and gold table is read once, over its plan: no table is stored, and a row is never
    rebuilt: each table counts the hits of all its columns and patterns in one compiled aggregate, of which a row a task is sent.
    The cheap test before each pattern is for a character that every match holds.
    """
    counts = [found for t in LEAK_TABLES if (found := leaks(lake.undealt(t), t)) is not None]
    return reduce(DataFrame.unionByName, counts)


def leaks(df: DataFrame, table: str) -> DataFrame | None:
    """(table_name, column_name, pattern, hits) of the text columns of one table; None if it has none."""
    places = [(f.name, p) for f in df.schema if isinstance(f.dataType, T.StringType) for p in LEAK_PATTERNS]
    if not places:
        return None

    def test(column: str, pattern: str) -> str:
        mark, times = LEAK_MARKS[pattern]
        marked = f"contains(`{column}`, '{mark}')" if times == 1 else f"substring_index(`{column}`, '{mark}', {times}) <> `{column}`"
        return f"{marked} and `{column}` rlike r'{LEAK_PATTERNS[pattern]}'"

    # Expressions are texts here, as some 2,000 of them take long to build one call at a time.
    found = df.agg(*[F.expr(f"count_if({test(c, p)})").alias(f"n{i}") for i, (c, p) in enumerate(places)])
    rows = ", ".join(f"named_struct('table_name', '{table}', 'column_name', '{c}', 'pattern', '{p}', 'hits', n{i})" for i, (c, p) in enumerate(places))
    return found.selectExpr(f"inline(array({rows}))").where("hits > 0")


GOVERNANCE = {
    "mask_by_policy": masked_customers,
    "mask_by_policy_360": masked_customer_360,
    "hierarchy_closure": employee_closure,
    "hierarchy_closure_gl": gl_account_closure,
    "retention_due": retention_due,
    "freshness_check": freshness_check,
    "pii_leak_scan": pii_leak_scan,
}
