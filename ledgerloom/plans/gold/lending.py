"""Loan book, delinquency and fraud aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import count_where, mean, month_of, percent, total
from ledgerloom.sources.lake import Lake

CLASSIFIED = ("Substandard", "Doubtful")


def loan_portfolio_summary(lake: Lake) -> DataFrame:
    late = F.col("delinquency_status") != "Current"
    return lake.silver("loans").groupBy("loan_type", "risk_rating", "delinquency_status").agg(
        F.count(F.lit(1)).alias("loan_count"),
        total("original_amount").alias("total_originated"),
        total("current_balance").alias("total_outstanding"),
        mean("interest_rate", 4).alias("avg_interest_rate"),
        mean("fico_score_at_origination", 0).alias("avg_fico"),
        mean("ltv_ratio", 4).alias("avg_ltv"),
        mean("dti_ratio", 4).alias("avg_dti"),
        mean("term_months", 0).alias("avg_term_months"),
        count_where(late).alias("delinquent_count"),
        percent(count_where(late), F.count(F.lit(1))).alias("delinquency_rate_pct"),
    )


def delinquency_analysis(lake: Lake) -> DataFrame:
    classified = count_where(F.col("risk_rating").isin(*CLASSIFIED))
    return (
        lake.silver("loans").where(F.col("delinquency_status") != "Current")
        .groupBy(
            "loan_type", "originating_branch_id", F.col("naics_code").alias("industry_naics"), "delinquency_status")
        .agg(
            F.count(F.lit(1)).alias("loan_count"),
            total("current_balance").alias("total_balance"),
            mean("current_balance", 2).alias("avg_balance"),
            mean("fico_score_at_origination", 0).alias("avg_origination_fico"),
            mean("interest_rate", 4).alias("avg_rate"),
            mean("ltv_ratio", 4).alias("avg_ltv"),
            classified.alias("classified_count"),
            percent(classified, F.count(F.lit(1))).alias("classified_rate_pct"),
        )
    )


def fraud_analytics(lake: Lake) -> DataFrame:
    false_alarm = count_where(F.col("status").startswith("Closed - False"))
    return (
        lake.silver("fraud_alerts")
        .groupBy(month_of("alert_date").alias("alert_month"), "alert_type", "severity")
        .agg(
            F.count(F.lit(1)).alias("alert_count"),
            count_where(F.col("status").startswith("Closed - Confirmed")).alias("confirmed_fraud_count"),
            false_alarm.alias("false_positive_count"),
            percent(false_alarm, F.count(F.lit(1))).alias("false_positive_rate_pct"),
            total("loss_amount").alias("total_losses"),
            mean("fraud_score", 0).alias("avg_fraud_score"),
            mean("resolution_hours", 1).alias("avg_resolution_hours"),
            count_where(F.col("sar_filed")).alias("sar_count"),
        )
    )
