"""SQL twins of the data-quality queries."""

from __future__ import annotations

from ledgerloom.oracle.layers import BOOK_DAY, avg, dbl, define, div, ratio, rnd
from ledgerloom.quality.profile import PORTABLE_SHARE, QUARTILES
from ledgerloom.quality.rules import (
    ACCOUNT_ID, ACCOUNT_TYPES, CUSIP, CUSTOMER_ID, ISIN, KYC_STATUSES, MASKED_SSN, MIN_CUSTOMERS, RISK_RATINGS, SSN)
from ledgerloom.sources.bindings import BINDINGS, INJECTIONS

QUERIES: dict[str, str] = {}

# ---- bronze tables with their injected rows -----------------------------------------------------

for _table, _spec in INJECTIONS.items():
    _bad = ", ".join(f"{e} AS {c}" for c, e in _spec.values.items())
    define(f"dirty_{_table}", f"SELECT * FROM bronze_{_table} UNION ALL BY NAME "
                              f"SELECT * REPLACE ({_bad}) FROM bronze_{_table} WHERE {_spec.chosen}")

# ---- rule results ------------------------------------------------------------------------------


def scan(dataset: str, table: str, source: str, rules: list[tuple]) -> str:
    """One row per rule (name, dimension, column, predicate, threshold, term); a NULL predicate fails."""
    arms = []
    for name, dimension, column, ok, threshold, term in rules:
        if ok == "unique":
            failed, verdict = f"count({column}) - count(DISTINCT {column})", None
        elif ok.startswith("table:"):
            verdict = ok[6:]
            failed = f"CASE WHEN {verdict} THEN 0 ELSE count(*) END"
        else:
            failed, verdict = f"count(*) FILTER (NOT coalesce({ok}, FALSE))", None
        share = div("(n - f)", "n")
        arms.append(f"""
SELECT '{dataset}' AS dataset, '{table}' AS table_name, '{name}' AS rule_name, '{dimension}' AS dimension,
  {f"'{column}'" if column else 'CAST(NULL AS VARCHAR)'} AS column_name, {rnd(share + ' * 100', 4)} AS pass_rate,
  n AS rows_evaluated, CAST(f AS BIGINT) AS rows_failed, CAST({threshold} AS DOUBLE) AS threshold,
  {'v' if verdict else f'coalesce({share} >= {threshold}, TRUE)'} AS passed,
  {f"'{term}'" if term else 'CAST(NULL AS VARCHAR)'} AS term
FROM (SELECT count(*) AS n, {failed} AS f, {verdict or 'TRUE'} AS v FROM {source})""")
    return " UNION ALL ".join(arms)


def present(column: str, name: str) -> tuple:
    return name, "COMPLETENESS", column, f"{column} IS NOT NULL", 1, None


def valid(column: str | None, name: str, ok: str, threshold=1, term=None, dimension="VALIDITY") -> tuple:
    return name, dimension, column, ok, threshold, term


CUSTOMER_RULES = [
    present("customer_id", "customer-id-not-null"),
    valid("customer_id", "customer-id-format", f"regexp_matches(customer_id, '{CUSTOMER_ID}')"),
    present("first_name", "first-name-not-null"), present("last_name", "last-name-not-null"),
    valid("kyc_status", "kyc-status-valid", f"kyc_status IN {KYC_STATUSES}"),
    ("min-row-count", "VOLUME", None, f"table:count(*) >= {MIN_CUSTOMERS}", 1, None)]
ACCOUNT_RULES = [
    present("account_id", "account-id-not-null"), present("customer_id", "customer-id-not-null"),
    valid("account_type", "account-type-valid", f"account_type IN {ACCOUNT_TYPES}"),
    valid("current_balance", "balance-non-negative", "current_balance >= 0", term="account-balance")]
LOAN_RULES = [
    present("loan_id", "loan-id-not-null"), present("customer_id", "customer-id-not-null"),
    valid("original_amount", "amount-positive", "original_amount > 0"),
    valid("interest_rate", "rate-range", "interest_rate BETWEEN 0 AND 0.30"),
    valid("fico_score_at_origination", "fico-range", "fico_score_at_origination BETWEEN 300 AND 850", term="fico-score"),
    valid("risk_rating", "risk-rating-valid",
          f"risk_rating IN {RISK_RATINGS}")]
TABLE_RULES = [
    ("bronze", "customers", CUSTOMER_RULES), ("bronze", "accounts", ACCOUNT_RULES), ("bronze", "loans", LOAN_RULES),
    ("silver", "customers", [
        present("customer_id", "pk-not-null"), ("pk-unique", "UNIQUENESS", "customer_id", "unique", 1, None),
        valid("ssn_masked", "ssn-masked-format",
              f"ssn_masked IS NULL OR regexp_matches(ssn_masked, '{MASKED_SSN}')", term="tin"),
        valid(None, "dob-not-future", f"date_of_birth <= {BOOK_DAY}")]),
    ("silver", "loans", [
        present("loan_id", "pk-not-null"), ("pk-unique", "UNIQUENESS", "loan_id", "unique", 1, None),
        valid("original_amount", "amount-non-negative", "original_amount >= 0"),
        valid("current_balance", "balance-non-negative", "current_balance >= 0"),
        valid(None, "balance-vs-original", "current_balance <= original_amount * 1.5", 0.95, None, "CONSISTENCY")]),
    ("gold", "customer_360", [
        present("customer_id", "pk-not-null"), ("pk-unique", "UNIQUENESS", "customer_id", "unique", 1, None),
        valid("total_relationship_value", "relationship-value-non-negative", "total_relationship_value >= 0"),
        valid("total_deposit_balance", "deposits-non-negative", "total_deposit_balance >= 0")]),
    ("gold", "loan_portfolio_summary", [
        valid("loan_count", "count-non-negative", "loan_count >= 0"),
        valid("delinquency_rate_pct", "rate-pct-range", "delinquency_rate_pct BETWEEN 0 AND 100")]),
]
define("rule_results", " UNION ALL ".join(scan(d, f"{d}_{t}", f"{d}_{t}", rules) for d, t, rules in TABLE_RULES))

def _volume() -> str:
    from ledgerloom.oracle.gold import DOUBLES

    ruled = {f"{d}_{t}" for d, t, _ in TABLE_RULES}
    gold = [t for t in DOUBLES if not t.endswith(("_grain_safe", "_fixed"))]
    tables = [f"bronze_{t}" for t in BINDINGS] + [f"silver_{t}" for t in BINDINGS] + gold
    rule = [("has-rows", "VOLUME", None, "table:count(*) > 0", 1, None)]
    return " UNION ALL ".join(scan(t.partition("_")[0], t, t, rule) for t in tables if t not in ruled)


define("rule_volume", _volume())
define("rule_everything", "SELECT * FROM rule_results UNION ALL SELECT * FROM rule_volume")

RESULT = f"SELECT * REPLACE ({dbl('pass_rate')} AS pass_rate) FROM "
QUERIES["dq_rule_results"] = RESULT + "rule_results"
QUERIES["dq_volume_rules"] = RESULT + "rule_volume"
QUERIES["dq_scorecard"] = f"""
SELECT dataset, table_name, dimension, {dbl(avg('pass_rate', 2))} AS score FROM rule_everything GROUP BY 1, 2, 3"""
QUERIES["vw_dq_scorecard"] = QUERIES["dq_scorecard"]
QUERIES["vw_dq_by_dimension"] = f"""
SELECT dimension, {dbl(avg('pass_rate', 2))} AS avg_score, count(*) AS rule_count FROM rule_everything GROUP BY 1"""
QUERIES["vw_dq_failed_rules"] = f"""
SELECT dataset, table_name, rule_name, dimension, {dbl('pass_rate')} AS pass_rate FROM rule_everything WHERE NOT passed"""
QUERIES["vw_dq_rule_detail"] = f"""
SELECT dataset, table_name, rule_name, dimension, column_name, {dbl('pass_rate')} AS pass_rate, rows_evaluated,
  rows_failed FROM rule_everything"""

# ---- injected rows -----------------------------------------------------------------------------

INJECTED = {
    "loans": LOAN_RULES,
    "accounts": ACCOUNT_RULES,
    "customers": CUSTOMER_RULES + [
        valid(None, "ssn-format", f"regexp_matches(ssn, '{SSN}')"),
        valid(None, "dob-not-future", f"TRY_CAST(date_of_birth AS DATE) <= {BOOK_DAY}")],
    "securities": [
        present("security_id", "pk-not-null"), present("ticker", "ticker-not-null"),
        valid("cusip", "cusip-format", f"regexp_matches(cusip, '{CUSIP}')", term="cusip"),
        valid("isin", "isin-format", f"regexp_matches(isin, '{ISIN}')", term="isin")],
    "credit_cards": [
        present("card_id", "pk-not-null"), valid("apr", "apr-range", "apr BETWEEN 0 AND 0.3"),
        valid("fico_score", "fico-range", "fico_score BETWEEN 300 AND 850", term="fico-score")],
    "wire_transfers": [
        present("wire_id", "pk-not-null"), present("originator_customer_id", "originator-not-null"),
        valid("amount", "structuring-amount", "amount < 10000 OR amount > 10001")],
}
for _label, _table in (("loans", "loans"), ("accounts", "accounts"), ("customers", "customers"),
                       ("securities", "securities"), ("cards", "credit_cards"), ("wires", "wire_transfers")):
    QUERIES[f"dirty_{_label}"] = RESULT + "(" + scan(
        "bronze", f"bronze_{_table}", f"dirty_{_table}", INJECTED[_table]) + ")"
define("rule_before", " UNION ALL ".join(
    scan("bronze", f"bronze_{t}", f"bronze_{t}", rules) for t, rules in INJECTED.items()))
define("rule_after", " UNION ALL ".join(
    scan("bronze", f"bronze_{t}", f"dirty_{t}", rules) for t, rules in INJECTED.items()))
QUERIES["dq_rerun_delta"] = f"""
SELECT table_name, rule_name, {dbl('b.pass_rate')} AS before, {dbl('a.pass_rate')} AS after,
  {dbl('a.pass_rate - b.pass_rate')} AS delta, a.rows_failed - b.rows_failed AS new_failures
FROM rule_before b JOIN rule_after a USING (table_name, rule_name)"""
QUERIES["dq_by_term"] = f"""
SELECT term, count(*) AS rules, CAST(sum(rows_evaluated) AS BIGINT) AS rows_evaluated,
  CAST(sum(rows_failed) AS BIGINT) AS rows_failed, {dbl('min(pass_rate)')} AS worst_pass_rate
FROM (SELECT * FROM rule_after UNION ALL SELECT * FROM rule_results WHERE table_name = 'silver_customers')
WHERE term IS NOT NULL GROUP BY 1"""

_FICO = "fico_score_at_origination"
_GOOD = f"{_FICO} BETWEEN 300 AND 850"
_RATE = div(f"count(*) FILTER ({_GOOD})", "count(*)")
QUERIES["dq_trust_statement"] = f"""
SELECT 'avg_fico' AS metric, {dbl(ratio(f'sum({_FICO})', f'count({_FICO})', 2))} AS metric_value,
  {dbl(ratio(f'sum({_FICO}) FILTER ({_GOOD})', f'count(*) FILTER ({_GOOD})', 2))} AS value_on_valid_rows,
  count(*) AS rows_evaluated, count(*) - count(*) FILTER ({_GOOD}) AS rows_failed,
  {dbl(rnd(_RATE + ' * 100', 4))} AS pass_rate,
  CASE WHEN {_RATE} < 0.95 THEN 'Do not use' WHEN {_RATE} < 1 THEN 'Usable with care' ELSE 'Trusted' END AS verdict
FROM dirty_loans"""
_FLAGS = ", ".join(f"CASE WHEN NOT coalesce({ok}, FALSE) THEN '{name}' END" for name, _, _, ok, _, _ in LOAN_RULES)
QUERIES["dq_quarantine"] = f"""
SELECT loan_id, {_FICO}, risk_rating, concat_ws(',', {_FLAGS}) AS failed_rules,
  CAST(len(list_filter([{_FLAGS}], lambda x: x IS NOT NULL)) AS BIGINT) AS n_failed
FROM dirty_loans WHERE concat_ws(',', {_FLAGS}) <> ''"""
QUERIES["recon_breaks"] = f"""
SELECT custodian_name, reconciliation_status, count(*) AS feeds, count(*) FILTER (has_break) AS breaks,
  {dbl('sum(break_amount)')} AS net_break, {dbl('coalesce(sum(abs(break_amount)) FILTER (has_break), 0)')} AS gross_break,
  {dbl('max(abs(break_amount))')} AS largest_break
FROM silver_custodian_feeds GROUP BY 1, 2"""

# ---- templates ---------------------------------------------------------------------------------


def failing(columns: str, table: str, broken: str, doubles: str = "") -> str:
    cols = ", ".join(f"{dbl(c)} AS {c}" if c in doubles.split() else c for c in columns.split())
    return f"SELECT {cols} FROM {table} WHERE {broken}"


QUERIES["dq_cusip_format"] = failing(
    "security_id cusip", "dirty_securities", f"cusip IS NULL OR NOT regexp_matches(cusip, '{CUSIP}')")
QUERIES["dq_isin_format"] = failing(
    "security_id isin", "dirty_securities", f"isin IS NULL OR NOT regexp_matches(isin, '{ISIN}')")


def _unmasked(column: str) -> str:
    return f"{column} IS NULL OR NOT regexp_matches({column}, '{MASKED_SSN}')"


QUERIES["dq_masked_ssn"] = (
    failing("customer_id ssn_masked", "silver_customers", _unmasked("ssn_masked")) + " UNION ALL "
    + failing("customer_id ssn", "dirty_customers", _unmasked("ssn")))
QUERIES["dq_account_id_format"] = failing(
    "account_id customer_id", "dirty_accounts",
    f"account_id IS NULL OR NOT regexp_matches(account_id, '{ACCOUNT_ID}')")
QUERIES["dq_balance_non_negative"] = failing(
    "account_id current_balance", "dirty_accounts", "current_balance < 0", "current_balance")
QUERIES["dq_interest_rate_range"] = failing(
    "card_id apr", "dirty_credit_cards", "NOT apr BETWEEN 0 AND 0.30", "apr")
QUERIES["dq_fico_range"] = failing("loan_id fico_score_at_origination", "dirty_loans", f"NOT ({_GOOD})")
QUERIES["dq_date_not_future"] = failing(
    "kyc_id next_review_date", "silver_kyc_records", f"next_review_date > {BOOK_DAY}")
QUERIES["dq_date_ordering"] = failing(
    "alert_id alert_date resolved_date", "silver_fraud_alerts", "resolved_date IS NULL OR alert_date > resolved_date")
QUERIES["dq_foreign_key"] = """
SELECT l.loan_id, l.originating_branch_id FROM silver_loans l
LEFT JOIN (SELECT branch_id FROM silver_branches WHERE status = 'Open') b ON b.branch_id = l.originating_branch_id
WHERE b.branch_id IS NULL"""

# ---- profiles ----------------------------------------------------------------------------------

_PROFILED = {
    "loan_id": False, "loan_type": False, "original_amount": True, "current_balance": True, "interest_rate": True,
    "ltv_ratio": True, "fico_score_at_origination": True, "origination_date": False, "risk_rating": False,
    "collateral_description": False}


def _profile(column: str, numeric: bool) -> str:
    if numeric:
        x = f"CAST({column} AS DECIMAL(19,6))"
        n, s, q = dbl(f"count({column})"), dbl(f"sum({x})"), dbl(f"sum({x} * {x})")
        sd = f"CASE WHEN count({column}) > 1 THEN sqrt(greatest(({n} * {q} - {s} * {s}) / ({n} * ({n} - 1)), 0)) END"
        stats = [dbl(rnd(f"{s} / nullif({n}, 0)", 4)), dbl(rnd(sd, 4))]
        stats += [dbl(f"quantile_disc({column}, {p})") for p in (0.25, 0.5, 0.75)]
    else:
        stats = ["CAST(NULL AS DOUBLE)"] * 5
    names = ("mean", "stddev", "q1", "median", "q3")
    return f"""
SELECT '{column}' AS column_name, count(*) AS row_count, count(*) - count({column}) AS null_count,
  count(DISTINCT {column}) AS distinct_count, CAST(min({column}) AS VARCHAR) AS min_value,
  CAST(max({column}) AS VARCHAR) AS max_value, {', '.join(f'{v} AS {c}' for v, c in zip(stats, names))},
  {dbl(ratio(f'count(*) - count({column})', 'count(*)', 4))} AS null_ratio,
  {dbl(ratio(f'count(DISTINCT {column})', 'count(*)', 4))} AS distinct_ratio
FROM silver_loans"""


QUERIES["profile_exact_loans"] = " UNION ALL ".join(_profile(c, n) for c, n in _PROFILED.items())


def _columns(table: str, sampled: bool) -> str:
    """One row per column, whatever its type: values as text, with the name of their type to tell numbers."""
    part = f"(SELECT * FROM {table} WHERE substr(md5(coalesce(CAST(#1 AS VARCHAR), '')), 1, 2) < '{PORTABLE_SHARE}')" if sampled else table
    number = "x.t IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE') OR x.t LIKE 'DECIMAL%'"
    return f"""
SELECT '{table.partition("_")[0]}' AS dataset, '{table}' AS table_name, c AS column_name, count(*) AS row_count,
  count(*) - count(v) AS null_count, count(DISTINCT v) AS distinct_count, min(n) AS min_number, max(n) AS max_number,
  min(CASE WHEN NOT number THEN v END) AS min_text, max(CASE WHEN NOT number THEN v END) AS max_text,
  {dbl(ratio('sum(e)', 'count(e)', 4))} AS mean, {', '.join(f"quantile_disc(n, {q}) AS {name}" for q, name in zip(QUARTILES, ('q1', 'median', 'q3')))},
  {dbl(ratio('count(*) - count(v)', 'count(*)', 4))} AS null_ratio, {dbl(ratio('count(DISTINCT v)', 'count(*)', 4))} AS distinct_ratio
FROM (SELECT c, x.v AS v, {number} AS number, CASE WHEN {number} THEN TRY_CAST(x.v AS DOUBLE) END AS n,
    CASE WHEN {number} THEN TRY_CAST(x.v AS DECIMAL(28,6)) END AS e
  FROM (FROM (SELECT {{'v': CAST(COLUMNS(*) AS VARCHAR), 't': typeof(COLUMNS(*))}} FROM {part}) UNPIVOT (x FOR c IN (*)))) GROUP BY c"""


def _layer_tables() -> list[str]:
    from ledgerloom.oracle.gold import DOUBLES

    gold = [t for t in DOUBLES if not t.endswith(("_grain_safe", "_fixed"))]
    return [f"bronze_{t}" for t in BINDINGS] + [f"silver_{t}" for t in BINDINGS] + gold


QUERIES["profile"] = " UNION ALL ".join(_columns(t, False) for t in _layer_tables())
QUERIES["profile_sampled"] = " UNION ALL ".join(_columns(t, True) for t in _layer_tables())


def _summary(table: str) -> str:
    return f"""
SELECT '{table.partition("_")[0]}' AS dataset, '{table}' AS table_name, max(n) AS row_count, count(*) AS column_count,
  arg_min(c, p) FILTER (suffix(c, '_id') AND d = n) AS pk_column
FROM (SELECT c, min(p) AS p, count(*) AS n, count(DISTINCT v) FILTER (suffix(c, '_id')) AS d
  FROM (SELECT c, v, row_number() OVER () AS p FROM
    (FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM {table}) UNPIVOT INCLUDE NULLS (v FOR c IN (*)))) GROUP BY c)"""


QUERIES["vw_profile_summary"] = " UNION ALL ".join(map(_summary, _layer_tables()))
