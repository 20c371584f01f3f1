"""Rule declarations, and which rules each table has."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import day_lit, is_true


@dataclass(frozen=True)
class Rule:
    """One expectation.

    `ok(today)` is the row predicate; a NULL result fails unless `ignore_null`
    is set and the column is NULL. `kind` is `row`, `unique` or `table`; for a
    table rule `ok` is an aggregate.
    """

    name: str
    dimension: str
    column: str | None
    kind: str
    ok: Callable[[date], Column] | None = None
    threshold: float = 1.0
    ignore_null: bool = False
    term: str | None = None


def not_null(column: str, name: str) -> Rule:
    return Rule(name, "COMPLETENESS", column, "row", lambda today: F.col(column).isNotNull())


def matches(column: str, pattern: str, name: str, **kw) -> Rule:
    return Rule(name, "VALIDITY", column, "row", lambda today: F.col(column).rlike(pattern), **kw)


def one_of(column: str, values: tuple[str, ...], name: str) -> Rule:
    return Rule(name, "VALIDITY", column, "row", lambda today: F.col(column).isin(*values))


def between(column: str, low=None, high=None, name: str = "", strict: bool = False, **kw) -> Rule:
    def ok(today: date) -> Column:
        c, conds = F.col(column), []
        if low is not None:
            conds.append(c > low if strict else c >= low)
        if high is not None:
            conds.append(c <= high)
        out = conds[0]
        for cond in conds[1:]:
            out = out & cond
        return out

    return Rule(name, "VALIDITY", column, "row", ok, **kw)


def unique(column: str, name: str) -> Rule:
    return Rule(name, "UNIQUENESS", column, "unique")


def row_condition(name: str, dimension: str, ok: Callable[[date], Column], threshold: float = 1.0) -> Rule:
    return Rule(name, dimension, None, "row", ok, threshold)


def min_rows(n: int, name: str) -> Rule:
    return Rule(name, "VOLUME", None, "table", lambda today: F.count(F.lit(1)) >= n)


HAS_ROWS = Rule("has-rows", "VOLUME", None, "table", lambda today: F.count(F.lit(1)) > 0)

# Patterns and limits of the rule library.
CUSTOMER_ID = r"^CUST-\d{8}$"
MASKED_SSN = r"^XXX-XX-\d{4}$"
CUSIP = r"^[A-Z0-9]{9}$"
ISIN = r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
ACCOUNT_ID = r"^ACCT-\d{10}$"
SSN = r"^\d{3}-\d{2}-\d{4}$|^\d{9}$"
KYC_STATUSES = ("Verified", "Pending")
ACCOUNT_TYPES = ("CHECKING", "SAVINGS", "MONEY_MARKET", "CD", "IRA")
RISK_RATINGS = ("Pass", "Special Mention", "Substandard", "Doubtful", "Loss")
MIN_CUSTOMERS = 10_000
MAX_RATE = 0.30
FICO = (300, 850)

# Which rules each table has, with their names, columns and limits.
RULES: dict[str, tuple[Rule, ...]] = {
    "bronze_customers": (
        not_null("customer_id", "customer-id-not-null"),
        matches("customer_id", CUSTOMER_ID, "customer-id-format"),
        not_null("first_name", "first-name-not-null"),
        not_null("last_name", "last-name-not-null"),
        one_of("kyc_status", KYC_STATUSES, "kyc-status-valid"),
        min_rows(MIN_CUSTOMERS, "min-row-count"),
    ),
    "bronze_accounts": (
        not_null("account_id", "account-id-not-null"),
        not_null("customer_id", "customer-id-not-null"),
        one_of("account_type", ACCOUNT_TYPES, "account-type-valid"),
        between("current_balance", 0, None, "balance-non-negative", term="account-balance"),
    ),
    "bronze_loans": (
        not_null("loan_id", "loan-id-not-null"),
        not_null("customer_id", "customer-id-not-null"),
        between("original_amount", 0, None, "amount-positive", strict=True),
        between("interest_rate", 0, MAX_RATE, "rate-range"),
        between("fico_score_at_origination", *FICO, "fico-range", term="fico-score"),
        one_of("risk_rating", RISK_RATINGS, "risk-rating-valid"),
    ),
    "silver_customers": (
        not_null("customer_id", "pk-not-null"),
        unique("customer_id", "pk-unique"),
        matches("ssn_masked", MASKED_SSN, "ssn-masked-format", ignore_null=True, term="tin"),
        row_condition("dob-not-future", "VALIDITY", lambda today: F.col("date_of_birth") <= day_lit(today)),
    ),
    "silver_loans": (
        not_null("loan_id", "pk-not-null"),
        unique("loan_id", "pk-unique"),
        between("original_amount", 0, None, "amount-non-negative"),
        between("current_balance", 0, None, "balance-non-negative"),
        row_condition("balance-vs-original", "CONSISTENCY",
                      lambda today: F.col("current_balance") <= F.col("original_amount") * 1.5, 0.95),
    ),
    "gold_customer_360": (
        not_null("customer_id", "pk-not-null"),
        unique("customer_id", "pk-unique"),
        between("total_relationship_value", 0, None, "relationship-value-non-negative"),
        between("total_deposit_balance", 0, None, "deposits-non-negative"),
    ),
    "gold_loan_portfolio_summary": (
        between("loan_count", 0, None, "count-non-negative"),
        between("delinquency_rate_pct", 0, 100, "rate-pct-range"),
    ),
}

# Extra rules for the tables that receive injected rows and have no rules of their own.
INJECTION_RULES: dict[str, tuple[Rule, ...]] = {
    "loans": RULES["bronze_loans"],
    "accounts": RULES["bronze_accounts"],
    "customers": RULES["bronze_customers"] + (
        row_condition("ssn-format", "VALIDITY", lambda today: F.col("ssn").rlike(SSN)),
        row_condition("dob-not-future", "VALIDITY",
                      lambda today: F.try_to_date(F.col("date_of_birth"), "yyyy-MM-dd") <= day_lit(today)),
    ),
    "securities": (
        not_null("security_id", "pk-not-null"),
        not_null("ticker", "ticker-not-null"),
        matches("cusip", CUSIP, "cusip-format", term="cusip"),
        matches("isin", ISIN, "isin-format", term="isin"),
    ),
    "credit_cards": (
        not_null("card_id", "pk-not-null"),
        between("apr", 0, MAX_RATE, "apr-range"),
        between("fico_score", *FICO, "fico-range", term="fico-score"),
    ),
    "wire_transfers": (
        not_null("wire_id", "pk-not-null"),
        not_null("originator_customer_id", "originator-not-null"),
        Rule("structuring-amount", "VALIDITY", "amount", "row",
             lambda today: ~F.col("amount").between(10000, 10001)),
    ),
}


def passes(rule: Rule, today: date) -> Column:
    """Row predicate of a row rule: never NULL."""
    ok = is_true(rule.ok(today))
    return ok | F.col(rule.column).isNull() if rule.ignore_null else ok
