"""The analyst workload, and the business questions that need several tables.

Every LIMIT follows a total order, so a rerun returns the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import bands, count_where, or_zero, quarter_end, ratio
from ledgerloom.plans.gold import VARIANTS
from ledgerloom.plans.gold.customers import account_summary_dormancy_fixed
from ledgerloom.plans.gold.finance import latest_capital
from ledgerloom.plans.staging import call_report_rc
from ledgerloom.plans.views import customer_total_relationship
from ledgerloom.sources.lake import Lake

LOOKUP_CUSTOMER = "CUST-00000042"
PATTERNS_SINCE = "2001-01-01"
LARGE_WIRE = 10000
FICO_BANDS = ((800, "800+"), (740, "740-799"), (670, "670-739"), (580, "580-669"))
HIGH_NET_WORTH = ("Premier", "Private Banking")
CRE_DEFAULT_RATE = 0.05
CRE_LOSS_GIVEN_DEFAULT = 0.45
CROSS_SELL_AUM = 1_000_000


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n rows with the highest `by`; ties go to the smallest keys."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]).limit(n)


def ordered(lake: Lake, gold: str, columns: str, by: str, *ties: str) -> DataFrame:
    return lake.gold(gold).select(*columns.split()).orderBy(F.col(by).desc_nulls_last(), *ties)


def customer_lookup(lake: Lake) -> DataFrame:
    return lake.silver("customers").where(F.col("customer_id") == LOOKUP_CUSTOMER)


def top_depositors(lake: Lake) -> DataFrame:
    ranked = top(lake.gold("customer_360"), 20, "total_deposit_balance", "customer_id", "wm_client_id")
    return ranked.select("customer_id", "customer_segment", "total_deposit_balance")


def account_dormancy(lake: Lake) -> DataFrame:
    return lake.gold("account_summary").where("is_dormant").groupBy("account_type").agg(F.count(F.lit(1)).alias("cnt"))


def account_dormancy_fixed(lake: Lake) -> DataFrame:
    """The same count over the summary whose dormancy flag can fire."""
    return account_summary_dormancy_fixed(lake).where("is_dormant").groupBy("account_type").agg(F.count(F.lit(1)).alias("cnt"))


def branch_leaders(lake: Lake) -> DataFrame:
    ranked = top(lake.gold("branch_performance"), 20, "total_deposits", "branch_id")
    return ranked.select("branch_name", "region", "total_deposits", "total_loans", "deposits_per_employee")


def busiest_patterns(lake: Lake) -> DataFrame:
    recent = lake.gold("transaction_patterns").where(F.col("month") >= F.lit(PATTERNS_SINCE).cast("date"))
    ranked = top(recent, 20, "total_amount", "month", "channel", "merchant_category", "transaction_type")
    return ranked.select("channel", "merchant_category", "transaction_count", "total_amount")


def fico_distribution(lake: Lake) -> DataFrame:
    return (
        lake.silver("loans").groupBy(bands("fico_score_at_origination", FICO_BANDS, "<580").alias("fico_band"))
        .agg(F.count(F.lit(1)).alias("cnt")).orderBy("fico_band")
    )


def cre_concentration(lake: Lake) -> DataFrame:
    late = lake.gold("delinquency_analysis").where(F.col("loan_type") == "COMMERCIAL")
    return late.select("industry_naics", "loan_count", "total_balance").orderBy(F.col("total_balance").desc())


def client_aum(lake: Lake) -> DataFrame:
    ranked = top(lake.silver("wm_clients"), 20, "total_aum", "wm_client_id")
    return ranked.select("wm_client_id", "first_name", "last_name", "client_tier", "total_aum")


def portfolio_leaders(lake: Lake) -> DataFrame:
    ranked = top(lake.gold("portfolio_performance"), 20, "market_value", "portfolio_id")
    return ranked.select("portfolio_name", "market_value", "ytd_return", "avg_sharpe_ratio", "avg_alpha")


def advisor_leaders(lake: Lake) -> DataFrame:
    ranked = top(lake.gold("advisor_scorecard"), 10, "total_aum", "advisor_id")
    return ranked.select(
        "first_name", "last_name", "total_aum", "client_count", "avg_portfolio_ytd_return", "avg_sharpe_ratio")


def kyc_overdue(lake: Lake) -> DataFrame:
    return lake.silver("kyc_records").groupBy("due_diligence_level", "risk_score_category").agg(
        F.count(F.lit(1)).alias("total"), count_where(F.col("review_overdue")).alias("overdue"))


def large_wires(lake: Lake) -> DataFrame:
    return (
        lake.silver("wire_transfers").where(F.col("amount") >= LARGE_WIRE).groupBy("wire_type", "beneficiary_country")
        .agg(F.count(F.lit(1)).alias("cnt"), F.sum("amount").alias("total")).orderBy(F.col("total").desc())
    )


def balance_sheet(lake: Lake) -> DataFrame:
    sheet = lake.gold("balance_sheet_summary").select("category", "line_item", "amount")
    return sheet.orderBy("category", F.col("amount").desc())


def total_relationship(lake: Lake) -> DataFrame:
    return (
        customer_total_relationship(lake).groupBy("relationship_tier")
        .agg(F.count(F.lit(1)).alias("cnt"), F.sum("total_relationship_value").alias("total_value"))
        .orderBy(F.col("total_value").desc())
    )


WORKLOAD = {
    "wq_customer_lookup": customer_lookup,
    "wq_top_depositors": top_depositors,
    "wq_account_dormancy": account_dormancy,
    "wq_account_dormancy_fixed": account_dormancy_fixed,
    "wq_branch_performance": branch_leaders,
    "wq_transaction_patterns": busiest_patterns,
    "wq_loan_portfolio": lambda lake: ordered(
        lake, "loan_portfolio_summary", "loan_type risk_rating loan_count total_outstanding delinquency_rate_pct",
        "total_outstanding"),
    "wq_delinquency_by_type": lambda lake: ordered(
        lake, "delinquency_analysis", "loan_type delinquency_status loan_count total_balance", "total_balance"),
    "wq_fico_distribution": fico_distribution,
    "wq_cre_concentration": cre_concentration,
    "wq_client_aum": client_aum,
    "wq_portfolio_performance": portfolio_leaders,
    "wq_advisor_scorecard": advisor_leaders,
    "wq_asset_allocation": lambda lake: ordered(
        lake, "asset_allocation", "asset_class sector total_market_value avg_return_pct", "total_market_value"),
    "wq_fee_revenue": lambda lake: ordered(
        lake, "fee_revenue", "fee_type client_tier total_fees avg_fee_rate_bps", "total_fees"),
    "wq_fraud_trends": lambda lake: ordered(
        lake, "fraud_analytics", "alert_month alert_type alert_count confirmed_fraud_count false_positive_rate_pct",
        "alert_month"),
    "wq_aml_risk": lambda lake: ordered(
        lake, "aml_risk_scoring", "customer_segment kyc_risk_rating customer_count avg_risk_score sar_filings",
        "avg_risk_score"),
    "wq_kyc_overdue": kyc_overdue,
    "wq_large_wires": large_wires,
    "wq_regulatory_dashboard": lambda lake: lake.gold("regulatory_dashboard").select(
        "metric_category", "metric_name", "metric_value", "threshold", "status"),
    "wq_nim_by_product": lambda lake: ordered(
        lake, "net_interest_margin", "product balance_type total_balance avg_interest_rate", "total_balance"),
    "wq_capital_adequacy": lambda lake: ordered(
        lake, "capital_adequacy",
        "reporting_date capital_component capital_ratio regulatory_minimum buffer_above_minimum", "reporting_date"),
    "wq_balance_sheet": balance_sheet,
    "wq_market_risk_var": lambda lake: ordered(
        lake, "market_risk_var", "asset_class sector total_exposure var_99_1d var_99_10d", "var_99_10d"),
    "wq_total_relationship": total_relationship,
}


# ---- business questions -------------------------------------------------------------------------


def top5_relationship(lake: Lake) -> DataFrame:
    """The five customers worth most, each with one row however many wealth clients they are."""
    return top(_per_customer(lake), 5, "total_relationship_value", "customer_id").select(
        "customer_id", "first_name", "last_name", "customer_segment", "total_relationship_value")


def _per_customer(lake: Lake) -> DataFrame:
    """Customer 360 counted once per child row, with several wealth clients of a customer added up."""
    wide = VARIANTS["customer_360_grain_safe"](lake)
    whole = or_zero("deposits") + or_zero("card_credit") + or_zero("aum")
    return (
        wide.groupBy("customer_id", "first_name", "last_name", "customer_segment")
        .agg(
            F.max("total_accounts").alias("accounts"), F.max("total_loans").alias("loans"),
            F.max("total_cards").alias("cards"), F.count("wm_client_id").alias("wealth_clients"),
            F.max("total_deposit_balance").alias("deposits"), F.max("total_loan_balance").alias("loan_balance"),
            # credit is the part of the relationship value that is neither deposits nor wealth
            F.max(F.col("total_relationship_value") - or_zero("total_deposit_balance") - F.col("total_aum"))
            .alias("card_credit"),
            F.sum("total_aum").alias("aum"),
        )
        .withColumn("total_relationship_value", whole)
    )


def hnw_total_exposure(lake: Lake) -> DataFrame:
    return (
        _per_customer(lake).where(F.col("customer_segment").isin(*HIGH_NET_WORTH)).groupBy("customer_segment")
        .agg(
            F.count(F.lit(1)).alias("customers"), F.sum(or_zero("deposits")).alias("deposits"),
            F.sum("loan_balance").alias("loans"), F.sum("aum").alias("investments"),
            F.sum(or_zero("deposits") + F.col("loan_balance") + F.col("aum")).alias("total_exposure"),
        )
    )


def branch_combined_revenue(lake: Lake) -> DataFrame:
    """Loan interest of a branch next to the wealth revenue of the advisors in its office."""
    interest = lake.gold("net_interest_margin").where(F.col("balance_type") == "Loan").groupBy("branch_id").agg(
        F.sum("interest_income_est").alias("retail_revenue"))
    offices = lake.silver("advisors").select(
        F.col("advisor_id").alias("primary_advisor_id"), F.col("office_branch_id").alias("branch_id"))
    wealth = (
        VARIANTS["client_revenue_grain_safe"](lake).select("wm_client_id", "primary_advisor_id", "total_revenue")
        .join(offices, "primary_advisor_id").groupBy("branch_id")
        .agg(F.count(F.lit(1)).alias("wealth_clients"), F.sum("total_revenue").alias("wealth_revenue"))
    )
    branches = VARIANTS["branch_performance_grain_safe"](lake).select("branch_id", "branch_name", "total_deposits")
    return branches.join(interest, "branch_id", "left").join(wealth, "branch_id", "left").select(
        "branch_id", "branch_name", "total_deposits", or_zero("retail_revenue").alias("retail_revenue"),
        or_zero("wealth_clients").alias("wealth_clients"), or_zero("wealth_revenue").alias("wealth_revenue"),
        (or_zero("retail_revenue") + or_zero("wealth_revenue")).alias("combined_revenue"))


def kyc_gaps(lake: Lake) -> DataFrame:
    """Overdue reviews of high-risk customers with the wires they sent."""
    wires = lake.silver("wire_transfers").groupBy(F.col("originator_customer_id").alias("customer_id")).agg(
        F.count(F.lit(1)).alias("wires"), F.sum("amount").alias("wire_amount"),
        count_where(F.col("above_ctr_threshold")).alias("large_wires"))
    risky = lake.silver("customers").where(F.col("kyc_risk_rating") == "High").select(
        "customer_id", "customer_segment", "kyc_status")
    return (
        lake.silver("kyc_records").where("review_overdue")
        .select("kyc_id", "customer_id", "due_diligence_level", "next_review_date")
        .join(risky, "customer_id").join(wires, "customer_id", "left")
        .withColumns({c: or_zero(c) for c in ("wires", "wire_amount", "large_wires")})
    )


def cross_sell_mortgage(lake: Lake) -> DataFrame:
    """Wealthy clients without a mortgage, and private-banking customers without a wealth portfolio."""
    mortgages = lake.silver("loans").where(F.col("loan_type") == "MORTGAGE").select("customer_id").distinct()
    rich = lake.silver("wm_clients").where(
        (F.col("total_aum") >= CROSS_SELL_AUM) & F.col("retail_customer_id").isNotNull())
    no_mortgage = rich.join(
        mortgages, F.col("retail_customer_id") == F.col("customer_id"), "left_anti"
    ).select(F.lit("Mortgage for wealth client").alias("opportunity"), F.col("retail_customer_id").alias("customer_id"),
             "wm_client_id", "total_aum")
    invested = (
        lake.silver("wm_clients").select("wm_client_id", F.col("retail_customer_id").alias("customer_id"))
        .join(lake.silver("portfolios").select("wm_client_id").distinct(), "wm_client_id", "left_semi")
    )
    private = lake.silver("customers").where(F.col("customer_segment") == "Private Banking")
    no_wealth = private.join(invested, "customer_id", "left_anti").select(
        F.lit("Wealth portfolio for private banking").alias("opportunity"), "customer_id",
        F.lit(None).cast("string").alias("wm_client_id"), F.lit(None).cast("decimal(18,2)").alias("total_aum"))
    return no_mortgage.unionByName(no_wealth)


def cre_stress(lake: Lake) -> DataFrame:
    """Capital ratios after a five percent default of the commercial loan book."""
    loss_rate = F.lit(f"{CRE_DEFAULT_RATE * CRE_LOSS_GIVEN_DEFAULT:.4f}").cast("decimal(6,4)")
    book = lake.silver("loans").where(F.col("loan_type") == "COMMERCIAL")
    balance = book.agg(F.sum("current_balance")).scalar()
    loss = book.agg(F.round(F.sum("current_balance") * loss_rate, 2)).scalar()
    scenario = latest_capital(lake).select(
        "capital_component", "capital_amount", "risk_weighted_assets", balance.alias("cre_balance"),
        loss.alias("stressed_loss"))
    left = F.col("capital_amount") - F.col("stressed_loss")
    return scenario.select(
        "*", left.alias("stressed_capital"), ratio("capital_amount", "risk_weighted_assets", 4).alias("base_ratio"),
        ratio(left, "risk_weighted_assets", 4).alias("stressed_ratio"))


def product_penetration(lake: Lake) -> DataFrame:
    """Number of product families held by the twenty customers worth most."""
    families = [F.when(F.col(c) > 0, 1).otherwise(0) for c in ("accounts", "loans", "cards", "wealth_clients")]
    ranked = top(_per_customer(lake), 20, "total_relationship_value", "customer_id")
    return ranked.select(
        "customer_id", "customer_segment", "total_relationship_value",
        sum(families[1:], families[0]).cast("bigint").alias("product_count"))


def filing_readiness(lake: Lake) -> DataFrame:
    """State of the filings of each quarter next to the staged schedule behind them."""
    filings = lake.silver("regulatory_filings").groupBy(quarter_end("reporting_period_end").alias("quarter")).agg(
        F.count(F.lit(1)).alias("filings"), count_where(F.col("actual_filing_date").isNotNull()).alias("filed"),
        count_where(F.col("filed_late")).alias("late"))
    staged = call_report_rc(lake).groupBy(F.col("reporting_date").alias("quarter")).agg(
        F.count(F.lit(1)).alias("staged_lines"),
        F.sum(F.col("amount").cast("decimal(28,0)")).alias("staged_amount"))
    return filings.join(staged, "quarter", "left").select(
        "quarter", "filings", "filed", "late", or_zero("staged_lines").alias("staged_lines"), "staged_amount",
        ((F.col("filed") == F.col("filings")) & (or_zero("staged_lines") > 0)).alias("ready"))


BUSINESS = {
    "bq_top5_relationship": top5_relationship,
    "bq_hnw_total_exposure": hnw_total_exposure,
    "bq_branch_combined_revenue": branch_combined_revenue,
    "bq_kyc_gaps": kyc_gaps,
    "bq_cross_sell_mortgage": cross_sell_mortgage,
    "bq_cre_stress": cre_stress,
    "bq_product_penetration": product_penetration,
    "bq_filing_readiness": filing_readiness,
}
