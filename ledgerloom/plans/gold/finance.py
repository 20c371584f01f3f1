"""Balance sheet, interest margin, capital, liquidity and the regulatory dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import (
    count_where,
    day_lit,
    dec,
    mean,
    or_zero,
    quarter_of,
    ratio,
    round_to,
    safe_div,
    total,
)
from ledgerloom.sources.lake import Lake

DEMAND_DEPOSITS = ("CHECKING", "SAVINGS")
KYC_OVERDUE_LIMIT = 0.05


def net_interest_margin(lake: Lake) -> DataFrame:
    def arm(frame: DataFrame, product: str, branch: str, kind: str) -> DataFrame:
        rates = safe_div(F.sum("interest_rate"), F.count("interest_rate"))
        return frame.groupBy(F.col(product).alias("product"), F.col(branch).alias("branch_id")).agg(
            F.count(F.lit(1)).alias("account_count"),
            total("current_balance").alias("total_balance"),
            mean("interest_rate", 6).alias("avg_interest_rate"),
            total(F.col("current_balance") * F.col("interest_rate")).alias("interest_income_est"),
            round_to(rates * 100, 4).alias("rate_pct"),
            F.lit(kind).alias("balance_type"),
        )

    active = lake.silver("accounts").where(F.col("account_status") == "Active")
    return arm(active, "account_type", "branch_id", "Deposit").unionByName(
        arm(lake.silver("loans"), "loan_type", "originating_branch_id", "Loan"))


def capital_adequacy(lake: Lake) -> DataFrame:
    stack = F.col("regulatory_minimum") + F.col("capital_conservation_buffer") + F.col("countercyclical_buffer")
    return lake.silver("regulatory_capital").select(
        "reporting_date", "capital_component", "capital_amount", "risk_weighted_assets", "capital_ratio",
        "regulatory_minimum", "capital_conservation_buffer", "countercyclical_buffer",
        F.round(stack, 4).alias("fully_loaded_minimum"), "buffer_above_minimum", "leverage_exposure",
        "leverage_ratio", "calculation_approach",
    )


def liquidity_coverage(lake: Lake) -> DataFrame:
    """Stressed outflows of the accounts opened in a quarter against the liquid assets held in it."""
    balance = F.col("current_balance")
    stress = F.when(F.col("account_type").isin(*DEMAND_DEPOSITS), balance * dec(F.lit(0.1), 2, 4)).otherwise(
        balance * dec(F.lit(0.25), 2, 4))
    deposits = (
        lake.silver("accounts").where(F.col("account_status") == "Active")
        .groupBy(quarter_of("open_date").alias("quarter"))
        .agg(F.sum(balance).alias("total_deposits"), F.sum(stress).alias("stressed_outflows"))
    )
    kind, value = F.col("security_type"), F.col("market_value")

    def level(cond, haircut: float):
        return F.sum(F.when(cond, value * dec(F.lit(haircut), 2, 4)).otherwise(dec(F.lit(0), 4)))

    liquid = (
        # one row per security and quarter goes into the join, however many lots are held
        lake.silver("holdings").groupBy("security_id", quarter_of("as_of_date").alias("quarter"))
        .agg(F.sum("market_value").alias("market_value"))
        .join(lake.silver("securities").select("security_id", "security_type", "credit_rating"), "security_id")
        .groupBy("quarter")
        .agg(
            level(kind.isin("Treasury Bond", "Money Market"), 1.0).alias("l1"),
            level(kind == "Municipal Bond", 0.85).alias("l2a"),
            level((kind == "Corporate Bond") & F.col("credit_rating").isin("AAA", "AA"), 0.5).alias("l2b"),
        )
    )
    hqla = or_zero("l1") + or_zero("l2a") + or_zero("l2b")
    return deposits.join(liquid, "quarter", "left").select(
        "quarter", "total_deposits", "stressed_outflows",
        or_zero("l1").alias("level_1_hqla"), or_zero("l2a").alias("level_2a_hqla"), or_zero("l2b").alias("level_2b_hqla"),
        F.round(hqla, 2).alias("total_hqla"),
        ratio(hqla, "stressed_outflows", 4).alias("lcr_ratio"),
    )


def latest_capital(lake: Lake) -> DataFrame:
    """Capital rows of the newest reporting date."""
    capital = lake.silver("regulatory_capital")
    newest = capital.agg(F.max("reporting_date").alias("reporting_date"))
    return capital.join(F.broadcast(newest), "reporting_date", "left_semi")  # one row


def regulatory_dashboard(lake: Lake) -> DataFrame:
    today = day_lit(lake.clock.book_day)
    enough = F.col("capital_ratio") >= F.col("regulatory_minimum")
    capital = latest_capital(lake).select(
        F.lit("Capital Adequacy").alias("metric_category"),
        F.col("capital_component").alias("metric_name"),
        F.col("capital_ratio").cast("double").alias("metric_value"),
        F.col("regulatory_minimum").cast("double").alias("threshold"),
        F.when(enough, "Pass").otherwise("Fail").alias("status"),
        F.col("reporting_date").alias("as_of_date"),
    )
    overdue = lake.silver("kyc_records").groupBy("risk_score_category").agg(
        safe_div(count_where(F.col("review_overdue")), F.count(F.lit(1))).alias("rate"))
    reviews = overdue.select(
        F.lit("BSA/AML").alias("metric_category"),
        F.concat(F.lit("KYC Overdue Rate - "), F.col("risk_score_category")).alias("metric_name"),
        round_to("rate", 4).cast("double").alias("metric_value"),
        F.lit(KYC_OVERDUE_LIMIT).alias("threshold"),
        F.when(F.col("rate") <= KYC_OVERDUE_LIMIT, "Pass").otherwise("Fail").alias("status"),
        today.alias("as_of_date"),
    )
    late = lake.silver("regulatory_filings").groupBy("report_name").agg(
        count_where(F.col("filed_late")).alias("late"))
    filings = late.select(
        F.lit("Filing Compliance").alias("metric_category"),
        F.concat(F.lit("Late Filing - "), F.col("report_name")).alias("metric_name"),
        F.col("late").cast("double").alias("metric_value"),
        F.lit(0.0).alias("threshold"),
        F.when(F.col("late") == 0, "Pass").otherwise("Fail").alias("status"),
        today.alias("as_of_date"),
    )
    return capital.unionByName(reviews).unionByName(filings)


def balance_sheet_summary(lake: Lake) -> DataFrame:
    """Six lines of the balance sheet; the three deposit lines come from one pass over the accounts."""
    balance = F.col("current_balance")
    demand = F.when(F.col("account_type").isin(*DEMAND_DEPOSITS), balance).otherwise(dec(F.lit(0)))
    deposits = lake.silver("accounts").where(F.col("account_status") == "Active").agg(
        F.sum(demand).alias("demand"), F.sum(balance).alias("deposits"))

    def share(c: str, part: float):
        return F.round(F.col(c) * dec(F.lit(part), 2, 4), 0)

    def entry(category: str, item: str, amount):
        return F.struct(
            F.lit(category).alias("category"), F.lit(item).alias("line_item"), amount.cast("double").alias("amount"))

    lines = deposits.select(F.inline(F.array(
        entry("Assets", "Cash and Due From Banks", share("demand", 0.05)),
        entry("Liabilities", "Total Deposits", F.round("deposits", 0)),
        entry("Liabilities", "Other Borrowed Funds", share("deposits", 0.15)),
    )))

    def line(frame: DataFrame, category: str, item: str, amount) -> DataFrame:
        return frame.agg(amount.cast("double").alias("amount")).select(
            F.lit(category).alias("category"), F.lit(item).alias("line_item"), "amount")

    total_capital = latest_capital(lake).where(F.col("capital_component") == "Total Capital")
    return (
        lines.unionByName(line(lake.silver("loans"), "Assets", "Total Loans and Leases", total("current_balance", 0)))
        .unionByName(line(lake.silver("holdings"), "Assets", "Investment Securities", total("market_value", 0)))
        .unionByName(line(total_capital, "Equity", "Total Equity Capital", F.round(F.max("capital_amount"), 0)))
    )
