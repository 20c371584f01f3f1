"""Wealth aggregates: portfolios, clients, advisors, fees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import mean, or_zero, ratio, round_to, safe_div, total
from ledgerloom.operators.fanout import Arm, at_least_one, join_groups, side_by_side
from ledgerloom.sources.lake import Lake

PORTFOLIO_COLUMNS = (
    "portfolio_id", "wm_client_id", "portfolio_name", "account_type", "tax_status", "market_value", "cost_basis",
    "total_return_pct", "ytd_return", "inception_return", "advisor_id", "benchmark_id",
)


def distinct_count(df: DataFrame, group: list[str], column: str, name: str) -> DataFrame:
    """Number of distinct values of a column in each group; no other column is read or shuffled."""
    return df.select(*group, column).distinct().groupBy(*group).agg(F.count(column).alias(name))


def portfolio_performance(lake: Lake) -> DataFrame:
    """Mean risk figures and holding counts of each active portfolio.

    The averages do not change when every performance row is repeated equally
    often, so this table is the same with and without the repetition.
    """
    measures = {"daily_return": 6, "alpha": 4, "beta": 4, "volatility": 4, "sharpe_ratio": 4, "excess_return": 6}
    track = lake.silver("performance").groupBy("portfolio_id").agg(
        *[mean(c, k).alias(f"avg_{c}") for c, k in measures.items()])
    # in passes of their own: side by side they would repeat every holding
    holdings, key = lake.silver("holdings"), "portfolio_id"
    lots = distinct_count(holdings, [key], "holding_id", "holding_count")
    classes = distinct_count(holdings, [key], "asset_class", "asset_class_count")
    names = lake.silver("benchmarks").select("benchmark_id", "benchmark_name").distinct()
    return (
        lake.silver("portfolios").where(F.col("status") == "Active").select(*PORTFOLIO_COLUMNS)
        .join(names, "benchmark_id", "left")
        .join(track, "portfolio_id", "left")
        .join(lots, "portfolio_id", "left")
        .join(classes, "portfolio_id", "left")
        .select(
            *PORTFOLIO_COLUMNS, "benchmark_name", *[f"avg_{c}" for c in measures],
            or_zero("holding_count").alias("holding_count"), or_zero("asset_class_count").alias("asset_class_count"))
    )


CLIENT_COLUMNS = ("wm_client_id", "first_name", "last_name", "client_tier", "primary_advisor_id", "total_aum")


def client_revenue(lake: Lake, repeat: bool = True) -> DataFrame:
    """Fees and commissions earned from each active wealth client."""
    fees = lake.silver("fee_schedules").where("is_active").groupBy("wm_client_id").agg(
        F.count(F.lit(1)).alias("active_fee_schedules"),
        F.sum("last_fee_amount").alias("billed"),
        mean("fee_rate_bps", 2).alias("avg_fee_rate_bps"),
    )
    traded = lake.silver("trades").groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("trade_rows"), F.sum("commission").alias("commission"), F.sum("fees").alias("trade_fees"))
    portfolios = (
        lake.silver("portfolios").select("wm_client_id", "portfolio_id").join(traded, "portfolio_id", "left")
        .groupBy("wm_client_id")
        .agg(
            F.sum(at_least_one("trade_rows")).alias("portfolio_rows"),
            F.sum("commission").alias("commission"),
            F.sum("trade_fees").alias("trade_fees"),
        )
    )
    clients = lake.silver("wm_clients").where(F.col("client_status") == "Active").select(*CLIENT_COLUMNS)
    joined = side_by_side(clients, "wm_client_id", [
        Arm(fees, "active_fee_schedules", ("billed",), ("avg_fee_rate_bps",)),
        Arm(portfolios, "portfolio_rows", ("commission", "trade_fees")),
    ], repeat=repeat)
    revenue = or_zero("billed") + or_zero("commission") + or_zero("trade_fees")
    return joined.select(
        *CLIENT_COLUMNS,
        "active_fee_schedules",
        F.round("billed", 2).alias("total_fees_billed"),
        "avg_fee_rate_bps",
        F.round("commission", 2).alias("total_commissions"),
        F.round("trade_fees", 2).alias("total_trade_fees"),
        F.round(revenue, 2).alias("total_revenue"),
        round_to(safe_div(revenue, F.col("total_aum")) * 10000, 2).alias("revenue_yield_bps"),
    )


def asset_allocation(lake: Lake) -> DataFrame:
    """Value of every asset class and sector, and how many portfolios and securities hold it.

    Each distinct count is a pass of its own over its two or three columns: side by side they would repeat every holding
    with all its sums, three times over.
    """
    group = ["asset_class", "sector"]
    holdings = lake.silver("holdings")

    totals = holdings.groupBy(*group).agg(
        total("market_value").alias("total_market_value"),
        total("cost_basis").alias("total_cost_basis"),
        total("unrealized_gain_loss").alias("total_unrealized_gain_loss"),
        mean("return_pct", 4).alias("avg_return_pct"),
        total("quantity").alias("total_quantity"),
    )
    counted = join_groups(
        distinct_count(holdings, group, "portfolio_id", "portfolio_count"),
        distinct_count(holdings, group, "security_id", "security_count"), group)
    return join_groups(counted, totals, group)


ADVISOR_COLUMNS = (
    "advisor_id", "first_name", "last_name", "title", "region", "certifications", "years_experience", "total_aum",
    "client_count", "avg_fee_bps",
)


def advisor_scorecard(lake: Lake, repeat: bool = True) -> DataFrame:
    """Portfolios managed and commissions earned by each active advisor.

    A portfolio's return weighs as often as it has performance rows, unless
    `repeat` is off.
    """
    track = lake.silver("performance").groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("perf_rows"),
        F.sum("sharpe_ratio").alias("sharpe_sum"), F.count("sharpe_ratio").alias("sharpe_rows"),
        F.sum("alpha").alias("alpha_sum"), F.count("alpha").alias("alpha_rows"),
    )
    copies = at_least_one("perf_rows") if repeat else F.lit(1)
    portfolios = (
        lake.silver("portfolios").where(F.col("status") == "Active").select("advisor_id", "portfolio_id", "ytd_return")
        .join(track, "portfolio_id", "left").groupBy("advisor_id")
        .agg(
            F.sum(at_least_one("perf_rows")).alias("portfolio_rows"),
            F.count(F.lit(1)).alias("managed_portfolios"),
            ratio(F.sum(F.col("ytd_return") * copies), F.sum(F.when(F.col("ytd_return").isNotNull(), copies)), 4)
            .alias("avg_portfolio_ytd_return"),
            ratio(F.sum("sharpe_sum"), F.sum("sharpe_rows"), 4).alias("avg_sharpe_ratio"),
            ratio(F.sum("alpha_sum"), F.sum("alpha_rows"), 4).alias("avg_alpha"),
        )
    )
    trades = lake.silver("trades").groupBy("advisor_id").agg(
        F.count(F.lit(1)).alias("trade_rows"),
        F.countDistinct("trade_id").alias("total_trades"),
        F.sum("commission").alias("commission"),
    )
    advisors = lake.silver("advisors").where(F.col("status") == "Active").select(*ADVISOR_COLUMNS)
    averages = ("avg_portfolio_ytd_return", "avg_sharpe_ratio", "avg_alpha")
    joined = side_by_side(advisors, "advisor_id", [
        Arm(portfolios, "portfolio_rows", (), ("managed_portfolios", *averages)),
        Arm(trades, "trade_rows", ("commission",), ("total_trades",)),
    ], repeat=repeat)
    return joined.select(
        *ADVISOR_COLUMNS,
        or_zero("managed_portfolios").alias("managed_portfolios"),
        *averages,
        or_zero("total_trades").alias("total_trades"),
        F.round("commission", 2).alias("total_commissions_earned"),
    )


def fee_revenue(lake: Lake) -> DataFrame:
    """Fees by type, frequency and client tier.

    Schedules are reduced to one row per client, type and frequency before the
    join, so a client with very many schedules is one row, and clients need no
    distinct count.
    """
    rate, fee = F.col("fee_rate_bps"), F.col("last_fee_amount")
    billed = lake.silver("fee_schedules").where("is_active").groupBy(
        "wm_client_id", "fee_type", "billing_frequency"
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum(rate).alias("rate_sum"), F.count(rate).alias("rate_n"),
        F.min(rate).alias("rate_min"), F.max(rate).alias("rate_max"),
        F.sum(fee).alias("fee_sum"), F.count(fee).alias("fee_n"))
    clients = lake.silver("wm_clients").select("wm_client_id", "client_tier")
    return (
        billed.join(clients, "wm_client_id").groupBy("fee_type", "billing_frequency", "client_tier")
        .agg(
            F.count(F.lit(1)).alias("client_count"),
            F.sum("n").alias("schedule_count"),
            ratio(F.sum("rate_sum"), F.sum("rate_n"), 2).alias("avg_fee_rate_bps"),
            F.round(F.sum("fee_sum"), 2).alias("total_fees"),
            ratio(F.sum("fee_sum"), F.sum("fee_n"), 2).alias("avg_fee_amount"),
            F.round(F.min("rate_min"), 2).alias("min_fee_rate_bps"),
            F.round(F.max("rate_max"), 2).alias("max_fee_rate_bps"),
        )
    )
