"""Market and operational risk aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import count_where, dbl, month_of, or_zero, percent, ratio, round_to
from ledgerloom.operators.fanout import at_least_one
from ledgerloom.sources.lake import Lake

# One-sided normal quantiles and the horizon of the ten-day figure.
Z_99 = 2.326
Z_95 = 1.645
HORIZON_DAYS = 10


def sample_stddev(n, s, s2):
    """Sample standard deviation from a count and exact sums of x and x squared; NULL below two values."""
    n, s, s2 = dbl(n), dbl(s), dbl(s2)
    variance = F.greatest((n * s2 - s * s) / (n * (n - 1)), F.lit(0.0))
    return F.when(n > 1, F.sqrt(variance))


def market_risk_var(lake: Lake, repeat: bool = True) -> DataFrame:
    """Parametric value at risk by asset class and sector.

    Holdings meet every market-data row of their security. Each security is
    reduced to its moments once; a position then weighs them by its holdings.
    """
    r = F.col("daily_return").cast("decimal(10,4)")
    quotes = lake.silver("market_data").groupBy("security_id").agg(
        F.count(F.lit(1)).alias("quote_rows"),
        F.count(r).alias("r_rows"), F.sum(r).alias("r_sum"), F.sum(r * r).alias("r2_sum"),
        F.count("duration").alias("dur_rows"), F.sum("duration").alias("dur_sum"),
        F.count("yield_to_maturity").alias("ytm_rows"), F.sum("yield_to_maturity").alias("ytm_sum"),
    )
    positions = lake.silver("holdings").groupBy("asset_class", "sector", "security_id").agg(
        F.count(F.lit(1)).alias("lots"), F.sum("market_value").alias("value"))
    lots = F.col("lots") if repeat else F.lit(1)
    value = F.col("value") * (at_least_one("quote_rows") if repeat else F.lit(1))
    grouped = positions.join(quotes, "security_id", "left").groupBy("asset_class", "sector").agg(
        F.count(F.lit(1)).alias("position_count"),
        F.sum(value).alias("value"),
        *[F.sum(F.col(c) * lots).alias(c)
          for c in ("r_rows", "r_sum", "r2_sum", "dur_rows", "dur_sum", "ytm_rows", "ytm_sum")],
    )
    sized = grouped.withColumn("sd", sample_stddev("r_rows", "r_sum", "r2_sum"))
    at_risk = dbl("value") * F.col("sd")
    return sized.select(
        "asset_class", "sector", "position_count",
        F.round("value", 2).alias("total_exposure"),
        ratio("r_sum", "r_rows", 6).alias("avg_daily_return"),
        round_to("sd", 6).alias("return_volatility"),
        round_to(at_risk * Z_99, 2).alias("var_99_1d"),
        round_to(at_risk * Z_95, 2).alias("var_95_1d"),
        round_to(at_risk * Z_99 * F.sqrt(F.lit(HORIZON_DAYS)), 2).alias("var_99_10d"),
        ratio("dur_sum", "dur_rows", 2).alias("avg_duration"),
        ratio("ytm_sum", "ytm_rows", 4).alias("avg_ytm"),
    )


def operational_risk(lake: Lake, repeat: bool = True) -> DataFrame:
    """System events per month next to the cases opened in that month.

    Every event of a month meets every case of it; only the per-month case
    count is joined, so nothing is multiplied out.
    """
    events = lake.silver("audit_events").groupBy(
        month_of("event_timestamp").alias("event_month"), "system_name", "event_type"
    ).agg(
        F.count(F.lit(1)).alias("events"),
        count_where(F.col("result") == "Failed").alias("failed"),
        count_where(F.col("sox_relevant")).alias("sox"),
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("source_ip").alias("unique_ips"),
    )
    cases = lake.silver("compliance_cases").groupBy(month_of("opened_date").alias("event_month")).agg(
        F.count(F.lit(1)).alias("cases"))
    copies = at_least_one("cases") if repeat else F.lit(1)
    return events.join(cases, "event_month", "left").select(
        "event_month", "system_name", "event_type",
        (F.col("events") * copies).alias("event_count"),
        (F.col("failed") * copies).alias("failed_count"),
        percent("failed", "events").alias("failure_rate_pct"),
        (F.col("sox") * copies).alias("sox_relevant_count"),
        "unique_users", "unique_ips",
        or_zero("cases").alias("compliance_cases"),
    )
