"""SQL twins of the reference, staging, snapshot and audit queries."""

from __future__ import annotations

from ledgerloom.config import CLOCK
from ledgerloom.oracle.layers import BOOK_TS, avg, dbl, define, pct, quarter_end, ratio
from ledgerloom.plans.snapshots import MONTHS, QUARTERS, month_ends, quarter_ends
from ledgerloom.plans.staging import CONSOLIDATED, LOAN_LINES
from ledgerloom.quality.rules import CUSIP, ISIN
from ledgerloom.sources.refdata import SCHEMAS


def _literal(v: object) -> str:
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def ref_table(name: str) -> str:
    rows, schema = SCHEMAS[name]
    columns = ", ".join(c.split()[0] for c in schema.split(", "))
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {values}) AS d({columns})"


QUERIES: dict[str, str] = {}

QUERIES["ref_naics_codes"] = f"""
SELECT l.naics_code, any_value(d.description) AS description, count(*) AS loan_count,
  {dbl('sum(l.current_balance)')} AS total_balance
FROM silver_loans l LEFT JOIN {ref_table('naics_codes')} USING (naics_code) GROUP BY 1"""
QUERIES["ref_country_codes"] = f"""
SELECT w.beneficiary_country, d.country_name, d.currency, count(*) AS wire_count, {dbl('sum(w.amount)')} AS total_amount
FROM silver_wire_transfers w LEFT JOIN {ref_table('country_codes')} ON d.country_code = w.beneficiary_country
GROUP BY ALL"""
QUERIES["ref_currency_codes"] = f"""
SELECT w.currency, d.currency_name, d.symbol, d.decimals, count(*) AS wire_count,
  {dbl('sum(CASE WHEN d.decimals = 0 THEN round(w.amount, 0) ELSE w.amount END)')} AS total_amount
FROM silver_wire_transfers w LEFT JOIN {ref_table('currency_codes')} ON d.currency_code = w.currency
GROUP BY ALL"""
_SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _adds_up(values: str, length: str, doubled: int, digit: str) -> str:
    """Sum of digits with every second value doubled, against the check digit."""
    v = f"({values})[i + 1] * CASE WHEN i % 2 = {doubled} THEN 2 ELSE 1 END"
    total = f"list_sum(list_transform(range({length}), lambda i: ({v}) // 10 + ({v}) % 10))"
    return f"(10 - {total} % 10) % 10 = TRY_CAST({digit} AS INTEGER)"


_CUSIP_VALUES = f"list_transform(range(1, 9), lambda k: instr('{_SIGNS}', cusip[k]) - 1)"
QUERIES["ref_cusip_master"] = f"""
SELECT cusip, min(security_name) AS issuer_name, min(security_type) AS security_type, min(country) AS country, count(*) AS securities,
  coalesce(regexp_matches(cusip, '{CUSIP}'), FALSE) AS well_formed,
  CASE WHEN regexp_matches(cusip, '{CUSIP}') THEN {_adds_up(_CUSIP_VALUES, '8', 1, 'cusip[9]')} END AS check_digit_ok
FROM silver_securities GROUP BY cusip"""
QUERIES["ref_isin_mapping"] = f"""
WITH d AS (SELECT DISTINCT isin, cusip FROM silver_securities),
n AS (SELECT *, reverse(array_to_string(list_transform(range(1, 12), lambda k: instr('{_SIGNS}', isin[k]) - 1), '')) AS digits FROM d),
v AS (SELECT *, list_transform(range(1, length(digits) + 1), lambda k: TRY_CAST(digits[k] AS INTEGER)) AS vals FROM n)
SELECT isin, cusip, isin[1:2] AS country_code, coalesce(isin[3:11] = cusip, FALSE) AS holds_cusip,
  CASE WHEN regexp_matches(isin, '{ISIN}') THEN {_adds_up('vals', 'len(vals)', 0, 'isin[12]')} END AS check_digit_ok
FROM v"""
QUERIES["ref_lei_registry"] = f"""
SELECT lei, min(counterparty_name) AS legal_name, min(country) AS jurisdiction, min(status) AS status, count(*) AS counterparties,
  {dbl('sum(total_exposure)')} AS total_exposure FROM silver_counterparties GROUP BY lei"""
QUERIES["ref_fed_district_codes"] = f"""
SELECT left(a.routing_number, 2) AS prefix, d.district_number, d.district_name, count(*) AS account_count,
  {dbl('sum(a.current_balance)')} AS total_balance
FROM silver_accounts a LEFT JOIN {ref_table('fed_district_codes')} ON d.routing_prefix = left(a.routing_number, 2)
GROUP BY ALL"""
QUERIES["ref_product_catalog"] = f"""
SELECT u.code AS product_code, d.product_name, d.category, d.division, count(*) AS holdings,
  {dbl('sum(u.amount)')} AS total_amount
FROM (SELECT account_type AS code, current_balance AS amount FROM silver_accounts
  UNION ALL SELECT loan_type, current_balance FROM silver_loans
  UNION ALL SELECT card_type, current_balance FROM silver_credit_cards
  UNION ALL SELECT account_type, market_value FROM silver_portfolios) u
LEFT JOIN {ref_table('product_catalog')} ON d.product_code = u.code GROUP BY ALL"""
QUERIES["fee_tier_assignment"] = f"""
SELECT w.wm_client_id, {dbl('w.total_aum')} AS total_aum, d.tier_name, d.advisory_fee_bps, d.management_fee_bps
FROM silver_wm_clients w LEFT JOIN {ref_table('fee_tiers')} ON w.total_aum BETWEEN d.min_aum AND d.max_aum"""

_POSTED = f"""
FROM silver_gl_entries e JOIN silver_gl_accounts a USING (gl_account_id)
LEFT JOIN {ref_table('gl_account_hierarchy')} ON CAST(a.account_number AS INTEGER)
  BETWEEN CAST(split_part(d.account_range, '-', 1) AS INTEGER) AND CAST(split_part(d.account_range, '-', 2) AS INTEGER)"""
QUERIES["gl_hierarchy_rollup"] = f"""
SELECT d.l1_type, d.l2_category, d.call_report_line, count(DISTINCT e.gl_account_id) AS gl_accounts,
  count(*) AS entry_count, {dbl("coalesce(sum(e.amount) FILTER (e.entry_type = 'Debit'), 0)")} AS total_debits,
  {dbl("coalesce(sum(e.amount) FILTER (e.entry_type = 'Credit'), 0)")} AS total_credits
{_POSTED} GROUP BY ALL"""

# ---- schedules ---------------------------------------------------------------------------------

_FILED = f"'Filed' AS status, {BOOK_TS} AS created_at"
_SIGN = ("CASE WHEN (d.l1_type IN ('Asset', 'Expense')) = (e.entry_type = 'Debit') THEN e.amount ELSE -e.amount END")
for _name, _prefix in (("rc", "RC-"), ("ri", "RI-")):
    define(f"staging_call_report_{_name}", f"""
SELECT {quarter_end('e.posting_date')} AS reporting_date, d.call_report_line AS schedule_line,
  d.l2_category AS line_description, {dbl(f'round(sum({_SIGN}), 0)')} AS amount, {_FILED}
{_POSTED} WHERE starts_with(d.call_report_line, '{_prefix}') GROUP BY 1, 2, 3""")


def _capital(n: int, text: str, value: str) -> str:
    return (f"SELECT reporting_date, 'RC-R-{n}' AS schedule_line, '{text}' AS line_description, "
            f"{dbl(value)} AS amount, {_FILED} FROM c")


define("staging_call_report_rc_r", f"""
WITH c AS (SELECT reporting_date, max(risk_weighted_assets) AS rwa, max(leverage_exposure) AS exposure,
    sum(capital_amount) FILTER (capital_component = 'CET1') AS cet1,
    sum(capital_amount) FILTER (capital_component IN ('CET1', 'Additional Tier 1')) AS tier1,
    sum(capital_amount) FILTER (capital_component = 'Total Capital') AS total
  FROM silver_regulatory_capital GROUP BY 1)
""" + " UNION ALL ".join([
    _capital(1, "Total RWA", "rwa"), _capital(2, "CET1 Capital", "cet1"), _capital(3, "Tier 1 Capital", "tier1"),
    _capital(4, "Total Capital", "total"), _capital(5, "CET1 Ratio", ratio("cet1", "rwa", 4)),
    _capital(6, "Tier 1 Ratio", ratio("tier1", "rwa", 4)), _capital(7, "Total Capital Ratio", ratio("total", "rwa", 4)),
    _capital(8, "Leverage Ratio", ratio("tier1", "exposure", 4))]))

_LINES = ", ".join(f"('{k}', '{c}', '{t}')" for k, (c, t) in LOAN_LINES.items())
define("staging_call_report_rc_c", f"""
WITH b AS (
  SELECT {quarter_end('origination_date')} AS q, loan_type AS kind, current_balance AS v FROM silver_loans
  UNION ALL SELECT {quarter_end('issue_date')}, 'CREDIT_CARD', current_balance FROM silver_credit_cards)
SELECT q AS reporting_date, d.code AS schedule_line, d.label AS line_description,
  {dbl('round(sum(v), 0)')} AS amount, {_FILED}
FROM b JOIN (VALUES {_LINES}) AS d(kind, code, label) USING (kind) GROUP BY 1, 2, 3
UNION ALL
SELECT q, 'RC-C-12', 'Total Loans and Leases', {dbl('round(sum(v), 0)')}, {_FILED} FROM b GROUP BY 1""")

_PARTS = ", ".join(f"('{code}', '{text}', '{part}')" for code, text, parts in CONSOLIDATED for part in parts)
define("staging_fr_y9c", f"""
SELECT s.reporting_date, d.code AS schedule_line, d.label AS line_description,
  {dbl('sum(CAST(s.amount AS DECIMAL(28,0)))')} AS amount, {_FILED}, 'Federal Reserve' AS regulatory_body
FROM (SELECT * FROM staging_call_report_rc UNION ALL SELECT * FROM staging_call_report_ri
  UNION ALL SELECT * FROM staging_call_report_rc_r UNION ALL SELECT * FROM staging_call_report_rc_c) s
JOIN (VALUES {_PARTS}) AS d(code, label, part) ON d.part = s.schedule_line GROUP BY 1, 2, 3""")
for _name in ("call_report_rc", "call_report_ri", "call_report_rc_r", "call_report_rc_c", "fr_y9c"):
    QUERIES[f"staging_{_name}"] = f"SELECT * FROM staging_{_name}"

# ---- snapshots ---------------------------------------------------------------------------------


def _days(days) -> str:
    return "(VALUES " + ", ".join(f"(DATE '{d}')" for d in days) + ") AS g(d)"


_IN_MONTH = "t.transaction_date >= date_trunc('month', g.d)"
QUERIES["snapshot_monthly_balances"] = f"""
SELECT a.account_id, g.d AS snapshot_date,
  {dbl("coalesce(sum(CASE WHEN t.transaction_type IN ('CREDIT', 'TRANSFER_IN', 'INTEREST') THEN t.amount "
       "ELSE -t.amount END), 0)")} AS balance,
  {dbl(f"coalesce(sum(t.amount) FILTER (t.transaction_type = 'INTEREST' AND {_IN_MONTH}), 0)")} AS mtd_interest_earned,
  count(t.transaction_id) FILTER ({_IN_MONTH}) AS transaction_count
FROM silver_accounts a JOIN {_days(month_ends(CLOCK.book_day, MONTHS))} ON a.open_date <= g.d
LEFT JOIN silver_transactions t ON t.account_id = a.account_id AND CAST(t.transaction_date AS DATE) <= g.d
GROUP BY 1, 2"""

_ENDS = quarter_ends(CLOCK.book_day, QUARTERS)
QUERIES["snapshot_quarterly_positions"] = f"""
WITH lots AS (
  SELECT portfolio_id, security_id, as_of_date, holding_id, market_value, cost_basis,
    greatest({quarter_end('as_of_date')}, DATE '{_ENDS[0]}') AS bucket
  FROM silver_holdings WHERE as_of_date <= DATE '{_ENDS[-1]}'),
newest AS MATERIALIZED (
  SELECT * FROM lots QUALIFY row_number() OVER (PARTITION BY portfolio_id, security_id, bucket
    ORDER BY as_of_date DESC, holding_id DESC) = 1),
spans AS (
  SELECT *, lead(bucket) OVER (PARTITION BY portfolio_id, security_id ORDER BY bucket) AS next_bucket FROM newest),
pos AS (
  SELECT portfolio_id, g.d, market_value, cost_basis
  FROM spans JOIN {_days(_ENDS)} ON g.d >= bucket AND (next_bucket IS NULL OR g.d < next_bucket)),
tot AS MATERIALIZED (SELECT portfolio_id, d, sum(market_value) AS mv, sum(cost_basis) AS cb, count(*) AS n FROM pos GROUP BY 1, 2)
SELECT t.portfolio_id, t.d AS snapshot_date, {dbl('t.mv')} AS market_value, {dbl('t.cb')} AS cost_basis,
  {dbl(ratio('t.mv - q.mv', 'q.mv', 4))} AS qtd_return, {dbl(ratio('t.mv - y.mv', 'y.mv', 4))} AS ytd_return,
  t.n AS holding_count
FROM tot t
LEFT JOIN tot q ON q.portfolio_id = t.portfolio_id AND q.d = last_day(t.d - INTERVAL 3 MONTH)
LEFT JOIN tot y ON y.portfolio_id = t.portfolio_id AND y.d = make_date(year(t.d) - 1, 12, 31)"""

QUERIES["snapshot_daily_market_data"] = f"""
WITH v AS (SELECT as_of_date AS snapshot_date, benchmark_name AS indicator, {avg('index_level', 2)} AS value
  FROM silver_benchmarks GROUP BY 1, 2),
p AS (SELECT *, lag(value) OVER (PARTITION BY indicator ORDER BY snapshot_date) AS prev FROM v)
SELECT snapshot_date, indicator, {dbl('value')} AS value, {dbl(ratio('value - prev', 'prev', 4))} AS daily_change_pct
FROM p"""
