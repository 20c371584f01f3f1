"""Customer, account, branch and money-laundering aggregates."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import (
    count_where,
    dec,
    is_true,
    mean,
    month_of,
    or_zero,
    percent,
    ratio,
    round_to,
    total,
    ts_lit,
)
from ledgerloom.operators.fanout import Arm, at_least_one, join_groups, left_join_many, side_by_side
from ledgerloom.operators.medians import group_medians
from ledgerloom.sources.lake import Lake

CUSTOMER_COLUMNS = (
    "customer_id", "first_name", "last_name", "customer_type", "customer_segment", "home_branch_id",
    "kyc_risk_rating", "kyc_status", "account_opened_date", "state", "industry",
)
DORMANCY_DAYS = 90
CTR_THRESHOLD = 10000
FRAUD_SCORE_ALERT = 70


def customer_360(lake: Lake, repeat: bool = True) -> DataFrame:
    """Deposits, loans, cards and wealth of each customer."""
    accounts = (
        lake.silver("accounts").where(F.col("account_status") == "Active").groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("total_accounts"), F.sum("current_balance").alias("deposits"))
    )
    loans = (
        lake.silver("loans").groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("total_loans"), F.sum("current_balance").alias("loan_balance"))
    )
    cards = (
        lake.silver("credit_cards").where(F.col("card_status") == "Active").groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("total_cards"),
            F.sum("current_balance").alias("card_balance"),
            F.sum("available_credit").alias("card_credit"),
        )
    )
    wealth = lake.silver("wm_clients").select(
        F.col("retail_customer_id").alias("customer_id"), "wm_client_id", F.col("client_tier").alias("wealth_tier"),
        F.col("total_aum").alias("aum")).where(F.col("customer_id").isNotNull())
    # A wealth client is part of the output grain, so it takes no repetition factor.
    parent = lake.silver("customers").select(*CUSTOMER_COLUMNS)
    parent = left_join_many(parent, wealth, "customer_id")
    joined = side_by_side(parent, "customer_id", [
        Arm(accounts, "total_accounts", ("deposits",)),
        Arm(loans, "total_loans", ("loan_balance",)),
        Arm(cards, "total_cards", ("card_balance", "card_credit")),
    ], repeat=repeat)
    return joined.select(
        *CUSTOMER_COLUMNS,
        "total_accounts",
        F.round("deposits", 2).alias("total_deposit_balance"),
        "total_loans",
        F.round(or_zero("loan_balance"), 2).alias("total_loan_balance"),
        "total_cards",
        F.round(or_zero("card_balance"), 2).alias("total_card_balance"),
        "wm_client_id",
        "wealth_tier",
        F.round(or_zero("aum"), 2).alias("total_aum"),
        F.round(or_zero("deposits") + or_zero("card_credit") + or_zero("aum"), 2).alias("total_relationship_value"),
        F.round(or_zero("loan_balance") + or_zero("card_balance"), 2).alias("total_credit_exposure"),
    )


ACCOUNT_COLUMNS = (
    "account_id", "customer_id", "account_type", "account_status", "current_balance", "interest_rate", "open_date",
    "branch_id",
)


def _account_activity(lake: Lake) -> DataFrame:
    cutoff = ts_lit(lake.clock.book - timedelta(days=DORMANCY_DAYS))
    recent = lake.silver("transactions").where(F.col("transaction_date") >= cutoff)
    of_type = {t: F.when(F.col("transaction_type") == t, F.col("amount")) for t in ("DEBIT", "CREDIT")}
    activity = recent.groupBy("account_id").agg(
        F.countDistinct("transaction_id").alias("transaction_count_90d"),
        F.sum(of_type["DEBIT"]).alias("debits"),
        F.sum(of_type["CREDIT"]).alias("credits"),
        mean("amount", 2).alias("avg_transaction_amount"),
        F.max("transaction_date").alias("last_transaction_date"),
    )
    return lake.silver("accounts").select(*ACCOUNT_COLUMNS).join(activity, "account_id", "left").select(
        *ACCOUNT_COLUMNS,
        or_zero("transaction_count_90d").alias("transaction_count_90d"),
        F.round(or_zero("debits"), 2).alias("total_debits_90d"),
        F.round(or_zero("credits"), 2).alias("total_credits_90d"),
        "avg_transaction_amount",
        "last_transaction_date",
    )


def account_summary(lake: Lake) -> DataFrame:
    """Ninety-day activity of each account.

    The dormancy flag looks at the same ninety days it was joined on, so it
    never fires; `account_summary_dormancy_fixed` is the one to use.
    """
    cutoff = ts_lit(lake.clock.book - timedelta(days=DORMANCY_DAYS))
    return _account_activity(lake).withColumn("is_dormant", is_true(F.col("last_transaction_date") < cutoff))


def account_summary_dormancy_fixed(lake: Lake) -> DataFrame:
    """As `account_summary`, dormant when the last transaction ever is older than ninety days, or there is none."""
    cutoff = ts_lit(lake.clock.book - timedelta(days=DORMANCY_DAYS))
    last = lake.silver("transactions").groupBy("account_id").agg(F.max("transaction_date").alias("last_ever"))
    return (
        _account_activity(lake).join(last, "account_id", "left")
        .withColumn("is_dormant", F.coalesce(F.col("last_ever") < cutoff, F.lit(True)))
        .drop("last_ever")
    )


def transaction_patterns(lake: Lake) -> DataFrame:
    """Monthly volumes by channel, merchant category and type.

    The distinct accounts and the medians are found on their own: next to a distinct
    count the other measures would be kept per account instead of per group.
    """
    keys = ["month", "channel", "merchant_category", "transaction_type"]
    rows = lake.silver("transactions").where(F.col("transaction_date").isNotNull()).select(
        month_of("transaction_date").alias("month"), *keys[1:], "account_id", "amount", "fraud_score")
    measures = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        total("amount").alias("total_amount"),
        mean("amount", 2).alias("avg_amount"),
        count_where(F.col("fraud_score") > FRAUD_SCORE_ALERT).alias("high_fraud_score_count"),
    )
    accounts = rows.groupBy(*keys).agg(F.countDistinct("account_id").alias("unique_accounts"))
    medians = group_medians(rows, keys, "amount", "median_amount")
    return join_groups(join_groups(measures, accounts, keys), medians, keys, "left").select(
        *keys, "transaction_count", "total_amount", "avg_amount", "median_amount", "high_fraud_score_count", "unique_accounts")


def aml_risk_scoring(lake: Lake, repeat: bool = True) -> DataFrame:
    """Customer due diligence, cases and large wires by risk class."""
    flags = ("pep_flag", "sanctions_flag", "adverse_media_flag", "review_overdue")
    kyc = lake.silver("kyc_records").groupBy("customer_id", "due_diligence_level", "risk_score_category").agg(
        F.count(F.lit(1)).alias("kyc_rows"),
        F.sum("risk_score").alias("score_sum"),
        F.count("risk_score").alias("score_rows"),
        *[count_where(F.col(f)).alias(f) for f in flags],
    )
    cases = lake.silver("compliance_cases").groupBy(F.col("related_customer_id").alias("customer_id")).agg(
        F.count(F.lit(1)).alias("cases"), count_where(F.col("sar_filed")).alias("sars"))
    wires = lake.silver("wire_transfers").groupBy(F.col("originator_customer_id").alias("customer_id")).agg(
        F.count(F.lit(1)).alias("wires"),
        F.sum(F.when(F.col("amount") >= CTR_THRESHOLD, F.col("amount")).otherwise(dec(F.lit(0)))).alias("large_wires"),
    )
    # One row per customer and risk class, so the distinct customers of a class are its rows.
    units = lake.silver("customers").select("customer_id", "customer_segment", "kyc_risk_rating").join(
        kyc, "customer_id", "left")
    joined = side_by_side(units, "customer_id", [
        Arm(cases, "cases", ("sars",)), Arm(wires, "wires", ("large_wires",))], repeat=repeat)
    # Factors of hot customers multiply past 64 bits, so products and their sums are decimals.
    k, w, c = (at_least_one(n).cast("decimal(19,0)") for n in ("kyc_rows", "wires", "cases"))
    others = (c * w).cast("decimal(38,0)") if repeat else F.lit(1).cast("decimal(1,0)")
    own = k if repeat else F.lit(1)
    grouped = joined.groupBy("customer_segment", "kyc_risk_rating", "due_diligence_level", "risk_score_category").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.sum(F.col("score_sum") * others).alias("score_sum"),
        F.sum(F.col("score_rows") * others).alias("score_rows"),
        *[F.sum(or_zero(f) * others).alias(f) for f in flags],
        F.sum(k * others).alias("joined_rows"),
        F.sum("cases").alias("compliance_cases"),
        F.sum(or_zero("sars") * own).alias("sar_filings"),
        F.sum(or_zero("large_wires") * own).alias("large_wires"),
    )
    return grouped.select(
        "customer_segment", "kyc_risk_rating", "due_diligence_level", "risk_score_category", "customer_count",
        ratio("score_sum", "score_rows", 0).alias("avg_risk_score"),
        F.col("pep_flag").cast("bigint").alias("pep_count"),
        F.col("sanctions_flag").cast("bigint").alias("sanctions_hit_count"),
        F.col("adverse_media_flag").cast("bigint").alias("adverse_media_count"),
        F.col("review_overdue").cast("bigint").alias("overdue_reviews"),
        percent("review_overdue", "joined_rows").alias("overdue_rate_pct"),
        "compliance_cases",
        F.col("sar_filings").cast("bigint").alias("sar_filings"),
        F.round("large_wires", 2).alias("large_wire_volume"),
    )


BRANCH_COLUMNS = ("branch_id", "branch_name", "city", "state", "region", "branch_type", "employee_count")


def branch_performance(lake: Lake, repeat: bool = True) -> DataFrame:
    """Deposits, loans and transactions of each open branch."""
    activity = lake.silver("transactions").groupBy("account_id").agg(
        F.count(F.lit(1)).alias("txn_rows"),
        F.countDistinct("transaction_id").alias("txns"),
        F.sum("amount").alias("txn_amount"),
    )
    held = (
        lake.silver("accounts").where(F.col("account_status") == "Active")
        .select("account_id", "branch_id", "current_balance").join(activity, "account_id", "left")
    )
    copies = at_least_one("txn_rows") if repeat else F.lit(1)
    accounts = held.groupBy("branch_id").agg(
        F.sum(copies).alias("account_rows"),
        F.count(F.lit(1)).alias("total_accounts"),
        F.sum(F.col("current_balance") * copies).alias("deposits"),
        F.sum(or_zero("txns")).alias("transaction_volume"),
        F.sum("txn_amount").alias("txn_amount"),
    )
    loans = lake.silver("loans").groupBy(F.col("originating_branch_id").alias("branch_id")).agg(
        F.count(F.lit(1)).alias("total_loans"), F.sum("current_balance").alias("loan_balance"))
    branches = lake.silver("branches").where(F.col("status") == "Open").select(*BRANCH_COLUMNS)
    joined = side_by_side(branches, "branch_id", [
        Arm(accounts, "account_rows", ("deposits", "txn_amount"), ("total_accounts", "transaction_volume")),
        Arm(loans, "total_loans", ("loan_balance",)),
    ], repeat=repeat)
    return joined.select(
        *BRANCH_COLUMNS,
        or_zero("total_accounts").alias("total_accounts"),
        F.round("deposits", 2).alias("total_deposits"),
        "total_loans",
        F.round(or_zero("loan_balance"), 2).alias("total_loan_balance"),
        or_zero("transaction_volume").alias("transaction_volume"),
        F.round(or_zero("txn_amount"), 2).alias("transaction_value"),
        ratio("deposits", "employee_count", 2).alias("deposits_per_employee"),
        round_to(F.try_divide(or_zero("total_accounts").cast("double"), F.col("employee_count").cast("double")), 0)
        .alias("accounts_per_employee"),
    )
