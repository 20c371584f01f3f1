"""SQL twins of the bronze and silver layers for the checking engine.

`expand` turns a query that names layer tables into one self-contained
statement by putting the definitions it needs in front of it.
"""

from __future__ import annotations

import re

from ledgerloom.config import CLOCK, STREAM_TABLES
from ledgerloom.sources.bindings import BINDINGS, Binding

BOOK_TS = f"TIMESTAMP '{CLOCK.book}'"
BOOK_DAY = f"DATE '{CLOCK.book_day}'"
STREAM_TS = f"TIMESTAMP '{CLOCK.stream}'"
STREAM_DAY = f"DATE '{CLOCK.stream_day}'"


def rnd(e: str, k: int) -> str:
    """Half-away-from-zero rounding of a double, as a decimal."""
    return f"round(CAST({e} AS DECIMAL(38,{k + 4})), {k})"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def ratio(a: str, b: str, k: int) -> str:
    return rnd(div(a, b), k)


def pct(a: str, b: str, k: int = 2) -> str:
    return rnd(f"{div(a, b)} * 100", k)


def avg(c: str, k: int) -> str:
    return ratio(f"sum({c})", f"count({c})", k)


def dbl(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


def month(e: str) -> str:
    return f"CAST(date_trunc('month', {e}) AS DATE)"


def quarter(e: str) -> str:
    return f"CAST(date_trunc('quarter', {e}) AS DATE)"


def quarter_end(e: str) -> str:
    return f"CAST(date_trunc('quarter', {e}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"


_QUARTERS = (
    f"(SELECT {quarter_end('o_orderdate')} AS quarter_end, "
    "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS booked, count(*) AS order_count "
    "FROM orders GROUP BY 1) CROSS JOIN (SELECT unnest(range({n})) AS slot)"
)
SOURCES = {
    "customer_feed": "(SELECT *, 0 AS age_days FROM customer "
                     "UNION ALL SELECT *, 1 FROM customer WHERE c_custkey % 50 = 0)",
    "order_lines": "lineitem JOIN orders ON l_orderkey = o_orderkey",
    "branch_sites": "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "replies": "(SELECT 'C-' || conv_id || '-' || turn AS reply_id, conv_id * 7 + turn AS k, text FROM conversations "
               "WHERE role = 'assistant' UNION ALL SELECT 'D-' || doc_id, doc_id, text FROM documents)",
    "market_days": "(SELECT l_suppkey % 10 AS slot, CAST(l_shipdate AS DATE) AS market_day, "
                   "CAST(sum(CAST(l_discount AS DECIMAL(12,6))) AS DECIMAL(18,6)) AS sum_discount, "
                   "CAST(sum(CAST(l_tax AS DECIMAL(12,6))) AS DECIMAL(18,6)) AS sum_tax, "
                   "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS turnover, "
                   "count(*) AS line_count FROM lineitem GROUP BY 1, 2)",
    "capital_quarters": _QUARTERS.format(n=4),
    "filing_quarters": _QUARTERS.format(n=8),
    "stress_quarters": _QUARTERS.format(n=24),
}


def bound_sql(b: Binding) -> str:
    cols = ", ".join(
        f"{e.format(ts='TIMESTAMP', branches='(SELECT count(*) FROM supplier)')} AS {c}" for c, e in b.columns.items()
    )
    where = f" WHERE {b.where}" if b.where else ""
    return f"SELECT {cols} FROM {SOURCES.get(b.source, b.source)}{where}"


def bronze_decimals(name: str) -> set[str]:
    return {c for c, e in BINDINGS[name].columns.items() if "DECIMAL(" in e}


def bronze_published(name: str) -> str:
    decimals = bronze_decimals(name)
    cols = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in decimals else c for c in BINDINGS[name].columns)
    return f"SELECT {cols} FROM bronze_{name}"


def _abs2(*cols: str) -> dict[str, str]:
    return {c: f"CAST(round(abs({c}), 2) AS DECIMAL(18,2))" for c in cols}


def _abs0(*cols: str) -> dict[str, str]:
    return {c: f"CAST(round(abs({c}), 0) AS DECIMAL(18,0))" for c in cols}


def _abs4(*cols: str) -> dict[str, str]:
    return {c: f"CAST(round(abs({c}), 4) AS DECIMAL(18,4))" for c in cols}


def _rel(a: str, b: str) -> str:
    return f"CAST({ratio(a, b, 4)} AS DECIMAL(18,4))"


_GAIN = _rel("market_value - cost_basis", "cost_basis")
_LATE_REVIEW = f"coalesce(next_review_date < {BOOK_DAY}, FALSE)"

# name -> (key, newest row only, extra row conditions, overridden columns, new columns)
SILVER = {
    "accounts": ("account_id", True, "customer_id IS NOT NULL", _abs2("current_balance", "available_balance"), {}),
    "ach_transfers": ("ach_id", False, "account_id IS NOT NULL", _abs2("amount"), {}),
    "advisors": ("advisor_id", True, "", _abs2("avg_fee_bps") | _abs0("total_aum"), {}),
    "atm_transactions": ("atm_transaction_id", False, "account_id IS NOT NULL", _abs2("amount", "surcharge_amount"), {}),
    "audit_events": ("audit_event_id", False, "", {}, {}),
    "benchmarks": ("benchmark_id", False, "", _abs2("index_level"), {}),
    "branches": ("branch_id", True, "", {}, {}),
    "card_transactions": ("card_transaction_id", False, "card_id IS NOT NULL", _abs2("amount"), {}),
    "client_goals": ("goal_id", True, "wm_client_id IS NOT NULL",
                     _abs0("target_amount", "current_amount")
                     | {"progress_pct": _rel("current_amount", "target_amount")}, {}),
    "compliance_cases": ("case_id", True, "", {}, {
        "resolution_days": "CAST(closed_date - opened_date AS BIGINT)",
        "aging_flag": f"closed_date IS NULL AND coalesce({STREAM_DAY} - opened_date > 30, FALSE)"}),
    "cost_centers": ("cost_center_id", True, "", _abs0("annual_budget"), {}),
    "counterparties": ("counterparty_id", True, "", _abs2("total_exposure", "credit_limit"),
                       {"utilization_ratio": _rel("total_exposure", "credit_limit")}),
    "credit_cards": ("card_id", True, "",
                     _abs2("current_balance", "available_credit", "annual_fee", "rewards_balance")
                     | _abs0("credit_limit"), {"utilization_ratio": _rel("current_balance", "credit_limit")}),
    "custodian_feeds": ("feed_id", False, "portfolio_id IS NOT NULL",
                        _abs2("market_value") | _abs4("quantity") | {"break_amount": "round(break_amount, 2)"},
                        {"has_break": "coalesce(abs(break_amount) > 0.01, FALSE)"}),
    "customers": ("customer_id", True, "", {
        "date_of_birth": "TRY_CAST(date_of_birth AS DATE)", "email": "lower(email)",
        "ssn": "CASE WHEN regexp_matches(ssn, '^[0-9]{3}-[0-9]{2}-[0-9]{4}$') THEN 'XXX-XX-' || right(ssn, 4) "
               "WHEN regexp_matches(ssn, '^[0-9]{9}$') THEN 'XXX-XX-' || right(ssn, 4) END",
        "tin": "'XXX-XX-' || substr(tin, 6, 4)"}, {}),
    "distributions": ("distribution_id", False, "portfolio_id IS NOT NULL",
                      _abs2("gross_amount", "tax_withheld", "net_amount"), {}),
    "employees": ("employee_id", True, "", {}, {}),
    "fee_schedules": ("fee_schedule_id", True, "", _abs2("fee_rate_bps", "last_fee_amount"),
                      {"is_active": f"end_date IS NULL OR end_date > {BOOK_DAY}"}),
    "fraud_alerts": ("alert_id", True, "", _abs2("loss_amount") | {
        "fraud_score": "CAST(round(fraud_score, 0) AS BIGINT)"},
        {"resolution_hours": "date_sub('hour', alert_date, resolved_date)"}),
    "fx_rates": ("fx_rate_id", False, "mid_rate > 0", {}, {"spread": "round(ask_rate - bid_rate, 6)"}),
    "gl_accounts": ("gl_account_id", True, "", {}, {}),
    "gl_entries": ("gl_entry_id", False, "gl_account_id IS NOT NULL AND status = 'Posted'", _abs2("amount"), {}),
    "holdings": ("holding_id", False, "portfolio_id IS NOT NULL AND security_id IS NOT NULL",
                 _abs2("market_price", "market_value", "cost_basis") | _abs4("quantity")
                 | {"unrealized_gain_loss": "CAST(market_value - cost_basis AS DECIMAL(18,2))"}, {"return_pct": _GAIN}),
    "interest_rates": ("rate_id", False, "rate_value >= 0", {}, {}),
    "kyc_records": ("kyc_id", True, "customer_id IS NOT NULL", {}, {"review_overdue": _LATE_REVIEW}),
    "loan_payments": ("payment_id", False, "loan_id IS NOT NULL", _abs2(
        "payment_amount", "principal_amount", "interest_amount", "escrow_amount", "late_fee"), {}),
    "loans": ("loan_id", True, "customer_id IS NOT NULL AND original_amount > 0",
              _abs2("original_amount", "current_balance"), {}),
    "market_data": ("market_data_id", False, "security_id IS NOT NULL AND close_price > 0", _abs2(
        "close_price", "open_price", "high_price", "low_price", "bid_price", "ask_price"), {}),
    "performance": ("performance_id", False, "portfolio_id IS NOT NULL",
                    _abs2("market_value") | {"net_flows": "round(net_flows, 2)"},
                    {"excess_return": "round(daily_return - benchmark_return, 6)"}),
    "portfolios": ("portfolio_id", True, "wm_client_id IS NOT NULL", _abs2("market_value", "cost_basis"),
                   {"total_return_pct": _GAIN}),
    "regulatory_capital": ("capital_id", False, "",
                           _abs0("capital_amount", "risk_weighted_assets", "leverage_exposure"),
                           {"buffer_above_minimum": "round(capital_ratio - regulatory_minimum, 4)"}),
    "regulatory_filings": ("filing_id", True, "", {}, {
        "filed_late": "coalesce(actual_filing_date > filing_due_date, FALSE)",
        "days_before_deadline": "CAST(filing_due_date - actual_filing_date AS BIGINT)"}),
    "risk_exposures": ("exposure_id", False, "",
                       _abs2("gross_exposure", "net_exposure", "collateral_value", "expected_loss"),
                       {"collateralization_ratio": _rel("collateral_value", "gross_exposure")}),
    "risk_profiles": ("risk_profile_id", True, "", _abs0("annual_income", "net_worth", "liquid_net_worth"),
                      {"review_overdue": _LATE_REVIEW}),
    "securities": ("security_id", True, "", _abs2("last_price"), {}),
    "stress_tests": ("stress_test_id", False, "", {"projected_impact": "round(projected_impact, 0)"}, {}),
    "trades": ("trade_id", False, "portfolio_id IS NOT NULL",
               _abs2("price", "gross_amount", "commission", "fees") | _abs4("quantity"),
               {"net_amount": "CAST(abs(gross_amount) - abs(commission) - abs(fees) AS DECIMAL(18,2))"}),
    "transactions": ("transaction_id", False, "account_id IS NOT NULL AND amount > 0", _abs2("amount"), {}),
    "wire_transfers": ("wire_id", False, "originator_account_id IS NOT NULL",
                       _abs2("amount") | {"above_ctr_threshold": "coalesce(amount >= 10000, FALSE)"}, {}),
    "wm_clients": ("wm_client_id", True, "", _abs2("total_aum") | {"tax_id": "'XXX-XX-' || substr(tax_id, 6, 4)"}, {}),
}
MASKED = {("customers", "ssn"): "ssn_masked", ("customers", "tin"): "tin_masked",
          ("wm_clients", "tax_id"): "tax_id_masked"}
SILVER_DECIMAL_EXTRAS = {"utilization_ratio", "spread", "return_pct", "excess_return", "total_return_pct",
                         "buffer_above_minimum", "collateralization_ratio", "net_amount"}


def silver_sql(name: str) -> str:
    key, newest, where, override, extra = SILVER[name]
    columns = list(BINDINGS[name].columns)
    source = f"bronze_{name}"
    if newest:
        rest = ", ".join(f"{c} DESC NULLS LAST" for c in columns if c not in (key, "created_at"))
        source = (f"(SELECT * FROM bronze_{name} QUALIFY row_number() OVER "
                  f"(PARTITION BY {key} ORDER BY created_at DESC NULLS LAST, {rest}) = 1) AS newest")
    projected = [f"{override.get(c, c)} AS {MASKED.get((name, c), c)}"
                 for c in columns]
    projected += [f"{e} AS {c}" for c, e in extra.items()]
    now = STREAM_TS if name in STREAM_TABLES else BOOK_TS
    conditions = " AND ".join(p for p in (f"{key} IS NOT NULL", where) if p)
    return f"SELECT {', '.join(projected)}, {now} AS silver_loaded_at FROM {source} WHERE {conditions}"


def silver_published(name: str) -> str:
    """A silver table with its exact decimals shown as doubles."""
    names = [MASKED.get((name, c), c) for c in BINDINGS[name].columns] + list(SILVER[name][4])
    decimals = (bronze_decimals(name) | (SILVER_DECIMAL_EXTRAS & set(names))) - {"fraud_score"}
    if name == "card_transactions" or name == "transactions":
        decimals.add("fraud_score")
    cols = [f"CAST({c} AS DOUBLE) AS {c}" if c in decimals else c for c in names]
    return f"SELECT {', '.join(cols)}, silver_loaded_at FROM silver_{name}"


_DEFINED = re.compile(r"\b((?:bronze|silver|gold|audit|vw|staging|dirty|rule|ev)_[a-z0-9_]+)\b")
DEFINITIONS: dict[str, str] = {}


def define(name: str, sql: str) -> None:
    DEFINITIONS[name] = sql


def _definition(table: str) -> str | None:
    layer, _, name = table.partition("_")
    if table in DEFINITIONS:
        return DEFINITIONS[table]
    if layer == "bronze" and name in BINDINGS:
        return bound_sql(BINDINGS[name])
    if layer == "silver" and name in BINDINGS:
        return silver_sql(name)
    return None


def expand(sql: str) -> str:
    """Prefix `sql` with the definition of every layer table it reaches."""
    order: list[str] = []

    def visit(text: str, skip: str = "") -> None:
        for table in dict.fromkeys(_DEFINED.findall(text)):
            if table == skip or table in order:
                continue
            body = _definition(table)
            if body is None:
                continue
            visit(body, table)
            if table not in order:
                order.append(table)

    visit(sql)
    if not order:
        return sql
    ctes = ", ".join(f"{t} AS ({_definition(t)})" for t in order)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own:
        return f"WITH {own[1] or ''}{ctes}, {sql[own.end():]}"
    return f"WITH {ctes} {sql}"
