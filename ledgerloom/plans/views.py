"""Dashboard views over gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import bands, or_zero
from ledgerloom.sources.lake import Lake

# Lower bound of each relationship tier.
RELATIONSHIP_TIERS = (
    (10_000_000, "Ultra High Net Worth"), (1_000_000, "High Net Worth"), (250_000, "Affluent"), (50_000, "Mass Affluent"))


def customer_total_relationship(lake: Lake) -> DataFrame:
    return lake.gold("customer_360").select(
        "customer_id", "first_name", "last_name", "customer_segment", "total_deposit_balance", "total_loan_balance",
        "total_card_balance", "total_aum", "total_relationship_value", "total_credit_exposure", "wealth_tier",
        bands("total_relationship_value", RELATIONSHIP_TIERS, "Mass Market").alias("relationship_tier"))


def _with_wealth(lake: Lake, portfolios: DataFrame) -> DataFrame:
    """Branch gold next to the wealth book found under the same branch id."""
    wealth = portfolios.groupBy("branch_id").agg(
        F.sum("market_value").alias("aum"), F.countDistinct("wm_client_id").alias("clients"))
    return lake.gold("branch_performance").join(wealth, "branch_id", "left").select(
        "branch_id", "branch_name", "city", "state", "region",
        F.col("total_deposits").alias("retail_deposits"),
        F.col("total_loan_balance").alias("retail_loans"),
        F.col("total_accounts").alias("retail_accounts"),
        "transaction_volume",
        F.round(or_zero("aum"), 2).alias("wealth_aum"),
        or_zero("clients").alias("wealth_clients"),
        F.round(F.col("total_deposits") + or_zero("aum"), 2).alias("combined_assets"))


def branch_retail_wealth(lake: Lake) -> DataFrame:
    """Joins branch ids to advisor ids, which never match: the wealth columns are always zero.

    Kept for parity; `branch_retail_wealth_fixed` goes through the advisor's office.
    """
    book = lake.silver("portfolios").select(F.col("advisor_id").alias("branch_id"), "market_value", "wm_client_id")
    return _with_wealth(lake, book)


def branch_retail_wealth_fixed(lake: Lake) -> DataFrame:
    offices = lake.silver("advisors").select("advisor_id", F.col("office_branch_id").alias("branch_id"))
    book = lake.silver("portfolios").select("advisor_id", "market_value", "wm_client_id").join(offices, "advisor_id")
    return _with_wealth(lake, book)


def regulatory_summary(lake: Lake) -> DataFrame:
    return lake.gold("regulatory_dashboard").select(
        "metric_category", "metric_name", "metric_value", "threshold", "status", "as_of_date")


VIEWS = {
    "vw_customer_total_relationship": customer_total_relationship,
    "vw_branch_retail_wealth": branch_retail_wealth,
    "vw_branch_retail_wealth_fixed": branch_retail_wealth_fixed,
    "vw_regulatory_summary": regulatory_summary,
}
