"""Period-end snapshots: balances per month, positions per quarter, market indicators per day."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import dec, mean, or_zero, quarter_end, ratio, round_to, safe_div
from ledgerloom.sources.lake import Lake

MONTHS = 12
QUARTERS = 8
INFLOWS = ("CREDIT", "TRANSFER_IN", "INTEREST")


def month_ends(before: date, n: int) -> list[date]:
    """The n month ends before `before`, oldest first."""
    out: list[date] = []
    end = before.replace(day=1) - timedelta(days=1)
    while len(out) < n:
        out.append(end)
        end = end.replace(day=1) - timedelta(days=1)
    return out[::-1]


def quarter_ends(before: date, n: int) -> list[date]:
    return [d for d in month_ends(before, 3 * n + 3) if d.month % 3 == 0][-n:]


def _grid(days: list[date]):
    return F.array(*[F.lit(d).cast("date") for d in days])


def _quarter_number(d) -> Column:
    return F.year(d) * 4 + F.quarter(d)


def monthly_balances(lake: Lake) -> DataFrame:
    """Balance, interest and activity of every account at each of the last month ends.

    Activity is summed per account and month first. What happened before the
    first month end counts towards its balance only.
    """
    ends = month_ends(lake.clock.book_day, MONTHS)
    first, last = F.lit(ends[0]).cast("date"), F.lit(ends[-1]).cast("date")
    kind, amount, end = F.col("transaction_type"), F.col("amount"), F.last_day(F.col("transaction_date").cast("date"))
    signed = F.when(kind.isin(*INFLOWS), amount).otherwise(-amount)
    in_month = end >= first
    activity = (
        lake.silver("transactions").where(end <= last)
        .groupBy("account_id", F.greatest(end, first).alias("snapshot_date"))
        .agg(
            F.sum(signed).alias("net"),
            F.sum(F.when(in_month & (kind == "INTEREST"), amount)).alias("interest"),
            F.count_if(in_month).alias("n"),
        )
    )
    grid = lake.silver("accounts").select("account_id", "open_date", F.explode(_grid(ends)).alias("snapshot_date"))
    so_far = Window.partitionBy("account_id").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.join(activity, ["account_id", "snapshot_date"], "left")
        .withColumn("balance", F.sum(or_zero("net")).over(so_far))
        .where(F.col("snapshot_date") >= F.col("open_date"))
        .select(
            "account_id", "snapshot_date", F.round("balance", 2).alias("balance"),
            F.round(or_zero("interest"), 2).alias("mtd_interest_earned"), or_zero("n").alias("transaction_count"))
    )


def quarterly_positions(lake: Lake) -> DataFrame:
    """Value, cost and returns of every portfolio at each of the last quarter ends.

    A position is the newest holding of a (portfolio, security) pair on or
    before the quarter end. Holdings shrink to one per pair and quarter before
    anything is ordered, so a pair with very many lots stays small.
    """
    ends = quarter_ends(lake.clock.book_day, QUARTERS)
    first, last = F.lit(ends[0]).cast("date"), F.lit(ends[-1]).cast("date")
    lots = Window.partitionBy("portfolio_id", "security_id", "bucket").orderBy(F.desc("as_of_date"), F.desc("holding_id"))
    newest = (
        lake.silver("holdings").where(F.col("as_of_date") <= last)
        .select("portfolio_id", "security_id", "market_value", "cost_basis", "as_of_date", "holding_id",
                F.greatest(quarter_end("as_of_date"), first).alias("bucket"))
        .withColumn("lot", F.row_number().over(lots)).where("lot = 1")
    )
    # A position holds from its own quarter end up to the one before its successor, so it is added at the one and taken
    # away at the other: one or two rows a position instead of one for each quarter end it is held at.
    pair = Window.partitionBy("portfolio_id", "security_id").orderBy("bucket")
    start = _quarter_number("bucket") - _quarter_number(first)
    stop = F.lead(_quarter_number("bucket")).over(pair) - _quarter_number(first)
    moves = newest.withColumns({"start": start, "stop": stop}).select(
        "portfolio_id", "market_value", "cost_basis", F.posexplode(F.array_compact(F.array("start", "stop"))).alias("leaves", "quarter"))

    def moved(amount) -> Column:
        return F.sum(F.when(F.col("leaves") == 0, amount).otherwise(-amount))

    values = ("market_value", "cost_basis")
    changes = moves.groupBy("portfolio_id", "quarter").agg(
        *[moved(F.col(c)).alias(c) for c in values],
        *[moved(F.when(F.col(c).isNotNull(), 1).otherwise(0)).alias(f"{c}_n") for c in values],
        moved(F.lit(1)).alias("holding_count"))
    # A portfolio's last positions never leave, so it has a row at each quarter end from its first one on.
    upcoming = F.lead("quarter").over(Window.partitionBy("portfolio_id").orderBy("quarter"))
    so_far = Window.partitionBy("portfolio_id").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    held = changes.select(
        "portfolio_id", F.sum("holding_count").over(so_far).alias("holding_count"),
        # without a known value among the positions held, the sum is unknown
        *[F.when(F.sum(f"{c}_n").over(so_far) > 0, F.sum(c).over(so_far)).alias(c) for c in values],
        "quarter", F.coalesce(upcoming, F.lit(len(ends))).alias("until"))
    totals = held.select(
        "portfolio_id", "holding_count", *values,
        F.explode(F.slice(_grid(ends), F.col("quarter") + 1, F.col("until") - F.col("quarter"))).alias("snapshot_date"))
    history = Window.partitionBy("portfolio_id").orderBy("snapshot_date")
    earlier = history.rowsBetween(Window.unboundedPreceding, -1)
    value = F.col("market_value")
    previous = F.lag(value).over(history)
    year_end = F.last(F.when(F.month("snapshot_date") == 12, value), ignorenulls=True).over(earlier)
    return totals.select(
        "portfolio_id", "snapshot_date", "market_value", "cost_basis",
        round_to(safe_div(value - previous, previous), 4).alias("qtd_return"),
        round_to(safe_div(value - year_end, year_end), 4).alias("ytd_return"),
        "holding_count")


def daily_market_data(lake: Lake) -> DataFrame:
    """Level of every indicator per day and its change on the day before."""
    levels = lake.silver("benchmarks").groupBy(
        F.col("as_of_date").alias("snapshot_date"), F.col("benchmark_name").alias("indicator")
    ).agg(dec(mean("index_level", 2)).alias("value"))
    previous = F.lag("value").over(Window.partitionBy("indicator").orderBy("snapshot_date"))
    return levels.select(
        "snapshot_date", "indicator", "value", ratio(F.col("value") - previous, previous, 4).alias("daily_change_pct"))


SNAPSHOTS = {
    "snapshot_monthly_balances": monthly_balances,
    "snapshot_quarterly_positions": quarterly_positions,
    "snapshot_daily_market_data": daily_market_data,
}
