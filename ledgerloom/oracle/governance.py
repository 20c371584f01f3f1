"""SQL twins of the governance queries."""

from __future__ import annotations

from ledgerloom.config import STREAM_TABLES
from ledgerloom.oracle.gold import DOUBLES
from ledgerloom.oracle.layers import BOOK_DAY, BOOK_TS, STREAM_TS, dbl
from ledgerloom.plans.governance import LEAK_PATTERNS, MASKING_KEY, asset_sources
from ledgerloom.plans.silver import SILVER

QUERIES: dict[str, str] = {}

_PEOPLE = ("first_name", "last_name", "email", "phone", "address_line1")


def _token(c: str) -> str:
    return f"sha256('{MASKING_KEY}' || sha256('{MASKING_KEY}' || {c})) AS {c}"


_HASHED = ", ".join(map(_token, _PEOPLE))
QUERIES["mask_by_policy"] = f"""
SELECT * REPLACE ({_HASHED}, CAST(NULL AS VARCHAR) AS ssn_masked, CAST(NULL AS DATE) AS date_of_birth)
FROM silver_customers"""
QUERIES["mask_by_policy_360"] = "SELECT * REPLACE (" + ", ".join(
    [f"{dbl(c)} AS {c}" for c in DOUBLES["gold_customer_360"]]
    + [_token("first_name"), _token("last_name")]) + ") FROM gold_customer_360"


def _closure(table: str, child: str, parent: str) -> str:
    return f"""
WITH RECURSIVE up(ancestor, descendant, depth) AS (
  SELECT {parent}, {child}, CAST(1 AS BIGINT) FROM {table} WHERE {parent} IS NOT NULL
  UNION
  SELECT e.{parent}, u.descendant, u.depth + 1 FROM up u JOIN {table} e ON e.{child} = u.ancestor
  WHERE e.{parent} IS NOT NULL AND u.depth < 40)
SELECT ancestor, descendant, min(depth) AS depth FROM up GROUP BY 1, 2"""


QUERIES["hierarchy_closure"] = _closure("silver_employees", "employee_id", "manager_id")
QUERIES["hierarchy_closure_gl"] = _closure("silver_gl_accounts", "gl_account_id", "parent_account_id")

_ENDS = {
    "fraud_alerts": "created_at", "kyc_records": "created_at", "compliance_cases": "created_at",
    "gl_accounts": "make_date(year(created_at), 12, 31)", "gl_entries": "make_date(year(posting_date), 12, 31)",
    "regulatory_capital": "make_date(year(reporting_date), 12, 31)", "regulatory_filings": "make_date(year(reporting_period_end), 12, 31)",
    "stress_tests": "make_date(year(projection_quarter), 12, 31)",
    "ach_transfers": "greatest(CAST(effective_date AS DATE), CAST(settlement_date AS DATE))",
    "distributions": "greatest(CAST(distribution_date AS DATE), CAST(settlement_date AS DATE))",
    "trades": "greatest(CAST(trade_date AS DATE), CAST(settlement_date AS DATE))",
    "fee_schedules": "greatest(CAST(end_date AS DATE), CAST(last_billing_date AS DATE))",
    "atm_transactions": "transaction_date", "card_transactions": "transaction_date", "transactions": "transaction_date",
    "audit_events": "event_timestamp", "client_goals": "target_date", "counterparties": "last_review_date",
    "credit_cards": "expiration_date", "loan_payments": "payment_date", "risk_profiles": "assessment_date",
    "securities": "maturity_date", "wire_transfers": "initiation_date",
    **dict.fromkeys(("benchmarks", "custodian_feeds", "fx_rates", "holdings", "interest_rates", "market_data", "performance", "risk_exposures"), "as_of_date"),
    "accounts": "CASE WHEN account_status IS DISTINCT FROM 'Active' THEN greatest(CAST(close_date AS DATE), "
                "(SELECT max(CAST(transaction_date AS DATE)) FROM silver_transactions t WHERE t.account_id = silver_accounts.account_id)) END",
    "loans": "greatest(CAST(maturity_date AS DATE), "
             "(SELECT max(CAST(payment_date AS DATE)) FROM silver_loan_payments p WHERE p.loan_id = silver_loans.loan_id))",
}
_SEVEN = {"fraud_alerts", "kyc_records", "compliance_cases", "gl_accounts", "gl_entries", "regulatory_capital", "regulatory_filings", "stress_tests"}


def _retention(t: str) -> str:
    years = 7 if t in _SEVEN else 5
    return f"""
SELECT '{t}' AS table_name, CAST({years} AS INTEGER) AS retention_years, count(*) AS rows_total,
  count(*) FILTER (CAST(start + INTERVAL {years} YEAR AS DATE) < {BOOK_DAY}) AS rows_due, min(start) AS oldest
FROM (SELECT CAST({_ENDS.get(t, 'NULL')} AS DATE) AS start FROM silver_{t})"""


QUERIES["retention_due"] = " UNION ALL ".join(map(_retention, SILVER))

_SOURCES = dict.fromkeys(a[4] for a in asset_sources())
_LOADS = " UNION ALL ".join(
    f"SELECT '{s}' AS source, max(created_at) FILTER (created_at <= {now}) AS loaded_at, {now} AS now FROM bronze_{s}"
    for s in _SOURCES for now in [STREAM_TS if s in STREAM_TABLES else BOOK_TS])
_CONTRACT = ", ".join(f"('{p}', '{a}', {e}, {k}, '{s}')" for p, a, e, k, s in asset_sources())
QUERIES["freshness_check"] = f"""
WITH loads AS ({_LOADS}), d(product, asset, every, slack, source) AS (VALUES {_CONTRACT}),
j AS (SELECT product, asset, date_sub('minute', loaded_at, now) AS age, every + slack AS lim, loaded_at
  FROM d JOIN loads USING (source))
SELECT product, asset, CASE WHEN bool_and(loaded_at IS NOT NULL) THEN max(age) END AS age_minutes, CAST(max(lim) AS BIGINT) AS limit_minutes,
  min(loaded_at) AS loaded_at, bool_and(loaded_at IS NOT NULL AND age <= lim) AS fresh FROM j GROUP BY 1, 2"""

_LEAK_TABLES = [f"silver_{t}" for t in SILVER] + [t for t in DOUBLES if not t.endswith(("_grain_safe", "_fixed"))]


def _leaks(t: str) -> str:
    counts = ", ".join(f"count(*) FILTER (regexp_matches(v, '{rx}')) AS {p}" for p, rx in LEAK_PATTERNS.items())
    return (f"SELECT '{t}' AS table_name, c AS column_name, {counts} FROM "
            f"(FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM {t}) UNPIVOT (v FOR c IN (*))) GROUP BY c")


QUERIES["pii_leak_scan"] = " UNION ALL ".join(
    f"SELECT table_name, column_name, '{p}' AS pattern, {p} AS hits FROM found WHERE {p} > 0" for p in LEAK_PATTERNS)
QUERIES["pii_leak_scan"] = f"WITH found AS MATERIALIZED ({' UNION ALL '.join(map(_leaks, _LEAK_TABLES))}) " + QUERIES["pii_leak_scan"]
