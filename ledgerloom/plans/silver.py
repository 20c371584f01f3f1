"""Silver: cleanse, deduplicate, mask and standardise the 40 bronze tables.

One declarative entry per table. Derived columns see the raw bronze values, so
a ratio is taken before the sign of its terms is dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import (
    abs_round,
    day_lit,
    dec,
    hours_between,
    is_true,
    mask_ssn,
    mask_tail,
    parse_day,
    ratio,
    ts_lit,
)
from ledgerloom.operators.latest import latest

Derivation = Callable[[datetime], Column]


@dataclass(frozen=True)
class Silver:
    key: str
    dedupe: bool = False
    required: tuple[str, ...] = ()
    where: Callable[[], Column] | None = None
    cents: tuple[str, ...] = ()  # |x| to 2 decimals
    units: tuple[str, ...] = ()  # |x| to whole units
    lots: tuple[str, ...] = ()  # |x| to 4 decimals
    derive: dict[str, Derivation] = field(default_factory=dict)
    swap: dict[str, tuple[str, Derivation]] = field(default_factory=dict)  # bronze column -> masked column


def _gain(pct: str) -> dict[str, Derivation]:
    return {pct: lambda now: dec(ratio(F.col("market_value") - F.col("cost_basis"), "cost_basis", 4), 4)}


def _share(name: str, part: str, whole: str) -> dict[str, Derivation]:
    return {name: lambda now: dec(ratio(part, whole, 4), 4)}


def _overdue(now: datetime) -> Column:
    return is_true(F.col("next_review_date") < day_lit(now.date()))


SILVER: dict[str, Silver] = {
    "accounts": Silver("account_id", True, ("customer_id",), cents=("current_balance", "available_balance")),
    "ach_transfers": Silver("ach_id", required=("account_id",), cents=("amount",)),
    "advisors": Silver("advisor_id", True, cents=("avg_fee_bps",), units=("total_aum",)),
    "atm_transactions": Silver("atm_transaction_id", required=("account_id",), cents=("amount", "surcharge_amount")),
    "audit_events": Silver("audit_event_id"),
    "benchmarks": Silver("benchmark_id", cents=("index_level",)),
    "branches": Silver("branch_id", True),
    "card_transactions": Silver("card_transaction_id", required=("card_id",), cents=("amount",)),
    "client_goals": Silver(
        "goal_id", True, ("wm_client_id",), units=("target_amount", "current_amount"),
        derive=_share("progress_pct", "current_amount", "target_amount")),
    "compliance_cases": Silver("case_id", True, derive={
        "resolution_days": lambda now: F.datediff("closed_date", "opened_date").cast("bigint"),
        "aging_flag": lambda now: F.col("closed_date").isNull()
        & is_true(F.datediff(day_lit(now.date()), F.col("opened_date")) > 30),
    }),
    "cost_centers": Silver("cost_center_id", True, units=("annual_budget",)),
    "counterparties": Silver(
        "counterparty_id", True, cents=("total_exposure", "credit_limit"),
        derive=_share("utilization_ratio", "total_exposure", "credit_limit")),
    "credit_cards": Silver(
        "card_id", True, cents=("current_balance", "available_credit", "annual_fee", "rewards_balance"),
        units=("credit_limit",), derive=_share("utilization_ratio", "current_balance", "credit_limit")),
    "custodian_feeds": Silver("feed_id", required=("portfolio_id",), cents=("market_value",), lots=("quantity",), derive={
        "break_amount": lambda now: dec(F.round("break_amount", 2)),
        "has_break": lambda now: is_true(F.abs("break_amount") > 0.01),
    }),
    "customers": Silver("customer_id", True, derive={
        "date_of_birth": lambda now: parse_day("date_of_birth"),
        "email": lambda now: F.lower("email"),
    }, swap={
        "ssn": ("ssn_masked", lambda now: mask_ssn("ssn")),
        "tin": ("tin_masked", lambda now: mask_tail("tin")),
    }),
    "distributions": Silver(
        "distribution_id", required=("portfolio_id",), cents=("gross_amount", "tax_withheld", "net_amount")),
    "employees": Silver("employee_id", True),
    "fee_schedules": Silver("fee_schedule_id", True, cents=("fee_rate_bps", "last_fee_amount"), derive={
        "is_active": lambda now: F.col("end_date").isNull() | (F.col("end_date") > day_lit(now.date())),
    }),
    "fraud_alerts": Silver("alert_id", True, cents=("loss_amount",), derive={
        # a fraction of a point rounds, it is not cut off
        "fraud_score": lambda now: F.round("fraud_score", 0).cast("bigint"),
        "resolution_hours": lambda now: hours_between("alert_date", "resolved_date"),
    }),
    "fx_rates": Silver("fx_rate_id", where=lambda: F.col("mid_rate") > 0, derive={
        "spread": lambda now: dec(F.round(F.col("ask_rate") - F.col("bid_rate"), 6), 6),
    }),
    "gl_accounts": Silver("gl_account_id", True),
    "gl_entries": Silver(
        "gl_entry_id", required=("gl_account_id",), where=lambda: F.col("status") == "Posted", cents=("amount",)),
    "holdings": Silver(
        "holding_id", required=("portfolio_id", "security_id"), cents=("market_price", "market_value", "cost_basis"),
        lots=("quantity",), derive={
            "unrealized_gain_loss": lambda now: dec(F.round(F.col("market_value") - F.col("cost_basis"), 2)),
            **_gain("return_pct"),
        }),
    "interest_rates": Silver("rate_id", where=lambda: F.col("rate_value") >= 0),
    "kyc_records": Silver("kyc_id", True, ("customer_id",), derive={"review_overdue": _overdue}),
    "loan_payments": Silver("payment_id", required=("loan_id",), cents=(
        "payment_amount", "principal_amount", "interest_amount", "escrow_amount", "late_fee")),
    "loans": Silver(
        "loan_id", True, ("customer_id",), where=lambda: F.col("original_amount") > 0,
        cents=("original_amount", "current_balance")),
    "market_data": Silver(
        "market_data_id", required=("security_id",), where=lambda: F.col("close_price") > 0,
        cents=("close_price", "open_price", "high_price", "low_price", "bid_price", "ask_price")),
    "performance": Silver("performance_id", required=("portfolio_id",), cents=("market_value",), derive={
        "net_flows": lambda now: dec(F.round("net_flows", 2)),
        "excess_return": lambda now: dec(F.round(F.col("daily_return") - F.col("benchmark_return"), 6), 6),
    }),
    "portfolios": Silver(
        "portfolio_id", True, ("wm_client_id",), cents=("market_value", "cost_basis"), derive=_gain("total_return_pct")),
    "regulatory_capital": Silver(
        "capital_id", units=("capital_amount", "risk_weighted_assets", "leverage_exposure"), derive={
            "buffer_above_minimum": lambda now: dec(
                F.round(F.col("capital_ratio") - F.col("regulatory_minimum"), 4), 4),
        }),
    "regulatory_filings": Silver("filing_id", True, derive={
        "filed_late": lambda now: is_true(F.col("actual_filing_date") > F.col("filing_due_date")),
        "days_before_deadline": lambda now: F.datediff("filing_due_date", "actual_filing_date").cast("bigint"),
    }),
    "risk_exposures": Silver(
        "exposure_id", cents=("gross_exposure", "net_exposure", "collateral_value", "expected_loss"),
        derive=_share("collateralization_ratio", "collateral_value", "gross_exposure")),
    "risk_profiles": Silver(
        "risk_profile_id", True, units=("annual_income", "net_worth", "liquid_net_worth"),
        derive={"review_overdue": _overdue}),
    "securities": Silver("security_id", True, cents=("last_price",)),
    "stress_tests": Silver("stress_test_id", derive={"projected_impact": lambda now: dec(F.round("projected_impact", 0))}),
    "trades": Silver(
        "trade_id", required=("portfolio_id",), cents=("price", "gross_amount", "commission", "fees"),
        lots=("quantity",), derive={
            "net_amount": lambda now: dec(
                F.round(F.abs("gross_amount") - F.abs("commission") - F.abs("fees"), 2)),
        }),
    "transactions": Silver(
        "transaction_id", required=("account_id",), where=lambda: F.col("amount") > 0, cents=("amount",)),
    "wire_transfers": Silver("wire_id", required=("originator_account_id",), cents=("amount",), derive={
        "above_ctr_threshold": lambda now: is_true(F.col("amount") >= 10000),
    }),
    "wm_clients": Silver("wm_client_id", True, cents=("total_aum",), swap={
        "tax_id": ("tax_id_masked", lambda now: mask_tail("tax_id")),
    }),
}


def _passes(spec: Silver) -> Column:
    """Whether a row goes on to silver, as far as the row alone tells; key first, then required columns and the filter."""
    tests = [F.col(c).isNotNull() for c in (spec.key, *spec.required)] + ([is_true(spec.where())] if spec.where is not None else [])
    return reduce(and_, tests)


def _columns(spec: Silver, names: list[str], now: datetime) -> dict[str, Column | None]:
    """Silver columns in their order, over a frame with the bronze columns; None where the bronze value goes through as it is."""
    columns: dict[str, Column | None] = {}
    for column in names:
        if column == "created_at":
            columns |= {c: make(now) for c, make in spec.derive.items() if c not in names}
        if column in spec.derive:
            columns[column] = spec.derive[column](now)
        elif column in spec.swap:
            masked, make = spec.swap[column]
            columns[masked] = make(now)
        elif column in spec.cents:
            columns[column] = abs_round(column, 2)
        elif column in spec.units:
            columns[column] = abs_round(column, 0)
        elif column in spec.lots:
            columns[column] = abs_round(column, 4)
        else:
            columns[column] = None
    return columns | {"silver_loaded_at": ts_lit(now)}


def refine(name: str, bronze: DataFrame, now: datetime) -> DataFrame:
    """Silver version of one bronze table as of `now`."""
    spec = SILVER[name]
    # The key filter commutes with the dedupe (it is the partition key), so it runs first.
    frame = bronze.where(F.col(spec.key).isNotNull())
    if spec.dedupe:
        frame = latest(frame, spec.key)
    for column in spec.required:
        frame = frame.where(F.col(column).isNotNull())
    if spec.where is not None:
        frame = frame.where(spec.where())
    return frame.select([F.col(c) if made is None else made.alias(c) for c, made in _columns(spec, bronze.columns, now).items()])


def beside(name: str, bronze: DataFrame, now: datetime) -> tuple[DataFrame, str, dict[str, str]] | None:
    """Every bronze row with its silver values beside it: the frame, its column that marks the rows of silver, and for each
    silver column the column that holds it. None where silver keeps one row of each key, which a row alone doesn't tell.
    """
    spec = SILVER[name]
    if spec.dedupe:
        return None
    made = _columns(spec, bronze.columns, now)
    places = {c: c if value is None else f"_silver_{c}" for c, value in made.items()}
    frame = bronze.select("*", *[value.alias(places[c]) for c, value in made.items() if value is not None], _passes(spec).alias("_passes"))
    return frame, "_passes", places
