"""SQL twins of the gold tables: the plain side-by-side joins, and the variants that count children once."""

from __future__ import annotations

from ledgerloom.oracle.layers import (
    BOOK_DAY,
    BOOK_TS,
    avg,
    dbl,
    define,
    div,
    month,
    pct,
    quarter,
    ratio,
    rnd,
)

DOUBLES: dict[str, tuple[str, ...]] = {}


def gold(name: str, sql: str, doubles: str = "") -> None:
    define(f"gold_{name}", sql)
    DOUBLES[f"gold_{name}"] = tuple(doubles.split())


def published(table: str) -> str:
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in DOUBLES[table])
    return f"SELECT * REPLACE ({casts}) FROM {table}" if casts else f"SELECT * FROM {table}"


# ---- customers ---------------------------------------------------------------------------------

_C360_KEYS = ("c.customer_id, c.first_name, c.last_name, c.customer_type, c.customer_segment, c.home_branch_id, "
              "c.kyc_risk_rating, c.kyc_status, c.account_opened_date, c.state, c.industry")
_C360_DOUBLES = ("total_deposit_balance total_loan_balance total_card_balance total_aum total_relationship_value "
                 "total_credit_exposure")
gold("customer_360", f"""
SELECT {_C360_KEYS},
  count(DISTINCT a.account_id) AS total_accounts, sum(a.current_balance) AS total_deposit_balance,
  count(DISTINCT l.loan_id) AS total_loans, coalesce(sum(l.current_balance), 0) AS total_loan_balance,
  count(DISTINCT k.card_id) AS total_cards, coalesce(sum(k.current_balance), 0) AS total_card_balance,
  w.wm_client_id, w.client_tier AS wealth_tier, coalesce(w.total_aum, 0) AS total_aum,
  coalesce(sum(a.current_balance), 0) + coalesce(sum(k.available_credit), 0) + coalesce(w.total_aum, 0)
    AS total_relationship_value,
  coalesce(sum(l.current_balance), 0) + coalesce(sum(k.current_balance), 0) AS total_credit_exposure
FROM silver_customers c
LEFT JOIN (SELECT * FROM silver_accounts WHERE account_status = 'Active') a USING (customer_id)
LEFT JOIN silver_loans l USING (customer_id)
LEFT JOIN (SELECT * FROM silver_credit_cards WHERE card_status = 'Active') k USING (customer_id)
LEFT JOIN silver_wm_clients w ON w.retail_customer_id = c.customer_id
GROUP BY {_C360_KEYS}, w.wm_client_id, w.client_tier, w.total_aum""", _C360_DOUBLES)

gold("customer_360_grain_safe", f"""
SELECT {_C360_KEYS},
  coalesce(a.n, 0) AS total_accounts, a.bal AS total_deposit_balance,
  coalesce(l.n, 0) AS total_loans, coalesce(l.bal, 0) AS total_loan_balance,
  coalesce(k.n, 0) AS total_cards, coalesce(k.bal, 0) AS total_card_balance,
  w.wm_client_id, w.client_tier AS wealth_tier, coalesce(w.total_aum, 0) AS total_aum,
  coalesce(a.bal, 0) + coalesce(k.credit, 0) + coalesce(w.total_aum, 0) AS total_relationship_value,
  coalesce(l.bal, 0) + coalesce(k.bal, 0) AS total_credit_exposure
FROM silver_customers c
LEFT JOIN (SELECT customer_id, count(*) n, sum(current_balance) bal FROM silver_accounts
           WHERE account_status = 'Active' GROUP BY 1) a USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) n, sum(current_balance) bal FROM silver_loans GROUP BY 1) l USING (customer_id)
LEFT JOIN (SELECT customer_id, count(*) n, sum(current_balance) bal, sum(available_credit) credit
           FROM silver_credit_cards WHERE card_status = 'Active' GROUP BY 1) k USING (customer_id)
LEFT JOIN silver_wm_clients w ON w.retail_customer_id = c.customer_id""", _C360_DOUBLES)

_ACCOUNT_KEYS = ("a.account_id, a.customer_id, a.account_type, a.account_status, a.current_balance, "
                 "a.interest_rate, a.open_date, a.branch_id")
_CUTOFF = f"{BOOK_TS} - INTERVAL 90 DAY"
_SUMMARY_DOUBLES = "current_balance interest_rate total_debits_90d total_credits_90d avg_transaction_amount"


def _account_summary(dormant: str) -> str:
    return f"""
SELECT {_ACCOUNT_KEYS},
  count(DISTINCT t.transaction_id) AS transaction_count_90d,
  coalesce(sum(t.amount) FILTER (t.transaction_type = 'DEBIT'), 0) AS total_debits_90d,
  coalesce(sum(t.amount) FILTER (t.transaction_type = 'CREDIT'), 0) AS total_credits_90d,
  {avg('t.amount', 2)} AS avg_transaction_amount,
  max(t.transaction_date) AS last_transaction_date,
  {dormant} AS is_dormant
FROM silver_accounts a
LEFT JOIN silver_transactions t ON t.account_id = a.account_id AND t.transaction_date >= {_CUTOFF}
LEFT JOIN (SELECT account_id, max(transaction_date) AS seen FROM silver_transactions GROUP BY 1) e
  ON e.account_id = a.account_id
GROUP BY {_ACCOUNT_KEYS}, e.seen"""


gold("account_summary", _account_summary(f"coalesce(max(t.transaction_date) < {_CUTOFF}, FALSE)"), _SUMMARY_DOUBLES)
gold("account_summary_dormancy_fixed", _account_summary(f"coalesce(e.seen < {_CUTOFF}, TRUE)"), _SUMMARY_DOUBLES)

gold("transaction_patterns", f"""
SELECT {month('transaction_date')} AS month, channel, merchant_category, transaction_type,
  count(*) AS transaction_count, sum(amount) AS total_amount, {avg('amount', 2)} AS avg_amount,
  quantile_disc(amount, 0.5) AS median_amount, count(DISTINCT account_id) AS unique_accounts,
  count(*) FILTER (fraud_score > 70) AS high_fraud_score_count
FROM silver_transactions WHERE transaction_date IS NOT NULL GROUP BY ALL""", "total_amount avg_amount median_amount")

_AML_DOUBLES = "avg_risk_score overdue_rate_pct large_wire_volume"
gold("aml_risk_scoring", f"""
SELECT c.customer_segment, c.kyc_risk_rating, k.due_diligence_level, k.risk_score_category,
  count(DISTINCT c.customer_id) AS customer_count, {avg('k.risk_score', 0)} AS avg_risk_score,
  count(*) FILTER (k.pep_flag) AS pep_count, count(*) FILTER (k.sanctions_flag) AS sanctions_hit_count,
  count(*) FILTER (k.adverse_media_flag) AS adverse_media_count,
  count(*) FILTER (k.review_overdue) AS overdue_reviews,
  {pct('count(*) FILTER (k.review_overdue)', 'count(*)')} AS overdue_rate_pct,
  count(DISTINCT p.case_id) AS compliance_cases, count(*) FILTER (p.sar_filed) AS sar_filings,
  sum(CASE WHEN w.amount >= 10000 THEN w.amount ELSE 0 END) AS large_wire_volume
FROM silver_customers c
LEFT JOIN silver_kyc_records k USING (customer_id)
LEFT JOIN silver_compliance_cases p ON p.related_customer_id = c.customer_id
LEFT JOIN silver_wire_transfers w ON w.originator_customer_id = c.customer_id
GROUP BY ALL""", _AML_DOUBLES)

gold("aml_risk_scoring_grain_safe", f"""
WITH unit AS (
  SELECT c.customer_id, c.customer_segment, c.kyc_risk_rating, k.due_diligence_level, k.risk_score_category,
    sum(k.risk_score) AS score, count(k.risk_score) AS scored, count(*) AS n,
    count(*) FILTER (k.pep_flag) AS pep, count(*) FILTER (k.sanctions_flag) AS sanc,
    count(*) FILTER (k.adverse_media_flag) AS media, count(*) FILTER (k.review_overdue) AS late
  FROM silver_customers c LEFT JOIN silver_kyc_records k USING (customer_id) GROUP BY ALL),
comp AS (SELECT related_customer_id AS customer_id, count(*) AS cases, count(*) FILTER (sar_filed) AS sars
  FROM silver_compliance_cases GROUP BY 1),
wire AS (SELECT originator_customer_id AS customer_id, sum(CASE WHEN amount >= 10000 THEN amount ELSE 0 END) AS big
  FROM silver_wire_transfers GROUP BY 1)
SELECT customer_segment, kyc_risk_rating, due_diligence_level, risk_score_category, count(*) AS customer_count,
  {ratio('sum(score)', 'sum(scored)', 0)} AS avg_risk_score, CAST(sum(pep) AS BIGINT) AS pep_count,
  CAST(sum(sanc) AS BIGINT) AS sanctions_hit_count, CAST(sum(media) AS BIGINT) AS adverse_media_count,
  CAST(sum(late) AS BIGINT) AS overdue_reviews, {pct('sum(late)', 'sum(n)')} AS overdue_rate_pct,
  CAST(coalesce(sum(cases), 0) AS BIGINT) AS compliance_cases, CAST(coalesce(sum(sars), 0) AS BIGINT) AS sar_filings,
  coalesce(sum(big), 0) AS large_wire_volume
FROM unit LEFT JOIN comp USING (customer_id) LEFT JOIN wire USING (customer_id) GROUP BY ALL""", _AML_DOUBLES)

_BRANCH_KEYS = "b.branch_id, b.branch_name, b.city, b.state, b.region, b.branch_type, b.employee_count"
_BRANCH_DOUBLES = "total_deposits total_loan_balance transaction_value deposits_per_employee accounts_per_employee"
gold("branch_performance", f"""
SELECT {_BRANCH_KEYS},
  count(DISTINCT a.account_id) AS total_accounts, sum(a.current_balance) AS total_deposits,
  count(DISTINCT l.loan_id) AS total_loans, coalesce(sum(l.current_balance), 0) AS total_loan_balance,
  count(DISTINCT t.transaction_id) AS transaction_volume, coalesce(sum(t.amount), 0) AS transaction_value,
  {ratio('sum(a.current_balance)', 'b.employee_count', 2)} AS deposits_per_employee,
  {ratio('count(DISTINCT a.account_id)', 'b.employee_count', 0)} AS accounts_per_employee
FROM silver_branches b
LEFT JOIN silver_accounts a ON a.branch_id = b.branch_id AND a.account_status = 'Active'
LEFT JOIN silver_loans l ON l.originating_branch_id = b.branch_id
LEFT JOIN silver_transactions t ON t.account_id = a.account_id
WHERE b.status = 'Open' GROUP BY {_BRANCH_KEYS}""", _BRANCH_DOUBLES)

gold("branch_performance_grain_safe", f"""
WITH acct AS (SELECT branch_id, count(*) AS n, sum(current_balance) AS bal FROM silver_accounts
  WHERE account_status = 'Active' GROUP BY 1),
txn AS (SELECT a.branch_id, count(DISTINCT t.transaction_id) AS n, sum(t.amount) AS amt
  FROM silver_transactions t JOIN silver_accounts a USING (account_id)
  WHERE a.account_status = 'Active' GROUP BY 1),
loan AS (SELECT originating_branch_id AS branch_id, count(*) AS n, sum(current_balance) AS bal
  FROM silver_loans GROUP BY 1)
SELECT {_BRANCH_KEYS}, coalesce(acct.n, 0) AS total_accounts, acct.bal AS total_deposits,
  coalesce(loan.n, 0) AS total_loans, coalesce(loan.bal, 0) AS total_loan_balance,
  coalesce(txn.n, 0) AS transaction_volume, coalesce(txn.amt, 0) AS transaction_value,
  {ratio('acct.bal', 'b.employee_count', 2)} AS deposits_per_employee,
  {ratio('coalesce(acct.n, 0)', 'b.employee_count', 0)} AS accounts_per_employee
FROM silver_branches b LEFT JOIN acct USING (branch_id) LEFT JOIN txn USING (branch_id) LEFT JOIN loan USING (branch_id)
WHERE b.status = 'Open'""", _BRANCH_DOUBLES)

# ---- lending -----------------------------------------------------------------------------------

gold("loan_portfolio_summary", f"""
SELECT loan_type, risk_rating, delinquency_status, count(*) AS loan_count,
  sum(original_amount) AS total_originated, sum(current_balance) AS total_outstanding,
  {avg('interest_rate', 4)} AS avg_interest_rate, {avg('fico_score_at_origination', 0)} AS avg_fico,
  {avg('ltv_ratio', 4)} AS avg_ltv, {avg('dti_ratio', 4)} AS avg_dti, {avg('term_months', 0)} AS avg_term_months,
  count(*) FILTER (delinquency_status <> 'Current') AS delinquent_count,
  {pct("count(*) FILTER (delinquency_status <> 'Current')", 'count(*)')} AS delinquency_rate_pct
FROM silver_loans GROUP BY ALL""",
     "total_originated total_outstanding avg_interest_rate avg_fico avg_ltv avg_dti avg_term_months delinquency_rate_pct")

_CLASSIFIED = "count(*) FILTER (risk_rating = 'Substandard' OR risk_rating = 'Doubtful')"
gold("delinquency_analysis", f"""
SELECT loan_type, originating_branch_id, naics_code AS industry_naics, delinquency_status, count(*) AS loan_count,
  sum(current_balance) AS total_balance, {avg('current_balance', 2)} AS avg_balance,
  {avg('fico_score_at_origination', 0)} AS avg_origination_fico, {avg('interest_rate', 4)} AS avg_rate,
  {avg('ltv_ratio', 4)} AS avg_ltv, {_CLASSIFIED} AS classified_count,
  {pct(_CLASSIFIED, 'count(*)')} AS classified_rate_pct
FROM silver_loans WHERE delinquency_status <> 'Current' GROUP BY ALL""",
     "total_balance avg_balance avg_origination_fico avg_rate avg_ltv classified_rate_pct")

_FALSE = "count(*) FILTER (starts_with(status, 'Closed - False'))"
gold("fraud_analytics", f"""
SELECT {month('alert_date')} AS alert_month, alert_type, severity, count(*) AS alert_count,
  count(*) FILTER (starts_with(status, 'Closed - Confirmed')) AS confirmed_fraud_count,
  {_FALSE} AS false_positive_count, {pct(_FALSE, 'count(*)')} AS false_positive_rate_pct,
  sum(loss_amount) AS total_losses, {avg('fraud_score', 0)} AS avg_fraud_score,
  {avg('resolution_hours', 1)} AS avg_resolution_hours, count(*) FILTER (sar_filed) AS sar_count
FROM silver_fraud_alerts GROUP BY ALL""",
     "false_positive_rate_pct total_losses avg_fraud_score avg_resolution_hours")

# ---- wealth ------------------------------------------------------------------------------------

_PORTFOLIO_KEYS = ", ".join("p." + c for c in (
    "portfolio_id wm_client_id portfolio_name account_type tax_status market_value cost_basis total_return_pct "
    "ytd_return inception_return advisor_id benchmark_id").split())
_PORTFOLIO_SQL = f"""
SELECT {_PORTFOLIO_KEYS}, m.benchmark_name,
  {avg('f.daily_return', 6)} AS avg_daily_return, {avg('f.alpha', 4)} AS avg_alpha, {avg('f.beta', 4)} AS avg_beta,
  {avg('f.volatility', 4)} AS avg_volatility, {avg('f.sharpe_ratio', 4)} AS avg_sharpe_ratio,
  {avg('f.excess_return', 6)} AS avg_excess_return, count(DISTINCT h.holding_id) AS holding_count,
  count(DISTINCT h.asset_class) AS asset_class_count
FROM silver_portfolios p
LEFT JOIN silver_performance f USING (portfolio_id)
LEFT JOIN silver_holdings h USING (portfolio_id)
LEFT JOIN (SELECT benchmark_id, benchmark_name FROM silver_benchmarks GROUP BY ALL) m USING (benchmark_id)
WHERE p.status = 'Active' GROUP BY {_PORTFOLIO_KEYS}, m.benchmark_name"""
_PORTFOLIO_DOUBLES = ("market_value cost_basis total_return_pct ytd_return inception_return avg_daily_return avg_alpha "
                      "avg_beta avg_volatility avg_sharpe_ratio avg_excess_return")
gold("portfolio_performance", _PORTFOLIO_SQL, _PORTFOLIO_DOUBLES)
gold("portfolio_performance_grain_safe", _PORTFOLIO_SQL, _PORTFOLIO_DOUBLES)

_CLIENT_KEYS = "c.wm_client_id, c.first_name, c.last_name, c.client_tier, c.primary_advisor_id, c.total_aum"
_CLIENT_DOUBLES = ("total_aum total_fees_billed avg_fee_rate_bps total_commissions total_trade_fees total_revenue "
                   "revenue_yield_bps")
_REVENUE = "coalesce(sum(s.last_fee_amount), 0) + coalesce(sum(t.commission), 0) + coalesce(sum(t.fees), 0)"
gold("client_revenue", f"""
SELECT {_CLIENT_KEYS}, count(DISTINCT s.fee_schedule_id) AS active_fee_schedules,
  sum(s.last_fee_amount) AS total_fees_billed, {avg('s.fee_rate_bps', 2)} AS avg_fee_rate_bps,
  sum(t.commission) AS total_commissions, sum(t.fees) AS total_trade_fees, {_REVENUE} AS total_revenue,
  {rnd(div(_REVENUE, 'c.total_aum') + ' * 10000', 2)} AS revenue_yield_bps
FROM silver_wm_clients c
LEFT JOIN (SELECT * FROM silver_fee_schedules WHERE is_active) s USING (wm_client_id)
LEFT JOIN silver_portfolios p ON p.wm_client_id = c.wm_client_id
LEFT JOIN silver_trades t ON t.portfolio_id = p.portfolio_id
WHERE c.client_status = 'Active' GROUP BY {_CLIENT_KEYS}""", _CLIENT_DOUBLES)

_SAFE_REVENUE = "coalesce(s.billed, 0) + coalesce(t.comm, 0) + coalesce(t.fees, 0)"
gold("client_revenue_grain_safe", f"""
SELECT {_CLIENT_KEYS}, coalesce(s.n, 0) AS active_fee_schedules, s.billed AS total_fees_billed,
  s.bps AS avg_fee_rate_bps, t.comm AS total_commissions, t.fees AS total_trade_fees,
  {_SAFE_REVENUE} AS total_revenue, {rnd(div(_SAFE_REVENUE, 'c.total_aum') + ' * 10000', 2)} AS revenue_yield_bps
FROM silver_wm_clients c
LEFT JOIN (SELECT wm_client_id, count(*) n, sum(last_fee_amount) billed, {avg('fee_rate_bps', 2)} bps
  FROM silver_fee_schedules WHERE is_active GROUP BY 1) s USING (wm_client_id)
LEFT JOIN (SELECT p.wm_client_id, sum(x.commission) comm, sum(x.fees) fees
  FROM silver_portfolios p JOIN silver_trades x USING (portfolio_id) GROUP BY 1) t USING (wm_client_id)
WHERE c.client_status = 'Active'""", _CLIENT_DOUBLES)

gold("asset_allocation", f"""
SELECT asset_class, sector, count(DISTINCT portfolio_id) AS portfolio_count,
  count(DISTINCT security_id) AS security_count, sum(market_value) AS total_market_value,
  sum(cost_basis) AS total_cost_basis, sum(unrealized_gain_loss) AS total_unrealized_gain_loss,
  {avg('return_pct', 4)} AS avg_return_pct, round(sum(quantity), 2) AS total_quantity
FROM silver_holdings GROUP BY ALL""",
     "total_market_value total_cost_basis total_unrealized_gain_loss avg_return_pct total_quantity")

_ADVISOR_KEYS = ", ".join("v." + c for c in (
    "advisor_id first_name last_name title region certifications years_experience total_aum client_count "
    "avg_fee_bps").split())
_ADVISOR_DOUBLES = ("total_aum avg_fee_bps avg_portfolio_ytd_return avg_sharpe_ratio avg_alpha "
                    "total_commissions_earned")
gold("advisor_scorecard", f"""
SELECT {_ADVISOR_KEYS}, count(DISTINCT p.portfolio_id) AS managed_portfolios,
  {avg('p.ytd_return', 4)} AS avg_portfolio_ytd_return, {avg('f.sharpe_ratio', 4)} AS avg_sharpe_ratio,
  {avg('f.alpha', 4)} AS avg_alpha, count(DISTINCT t.trade_id) AS total_trades,
  sum(t.commission) AS total_commissions_earned
FROM silver_advisors v
LEFT JOIN (SELECT * FROM silver_portfolios WHERE status = 'Active') p USING (advisor_id)
LEFT JOIN silver_performance f USING (portfolio_id)
LEFT JOIN silver_trades t USING (advisor_id)
WHERE v.status = 'Active' GROUP BY {_ADVISOR_KEYS}""", _ADVISOR_DOUBLES)

gold("advisor_scorecard_grain_safe", f"""
WITH book AS (SELECT advisor_id, count(*) AS n, {avg('ytd_return', 4)} AS ytd FROM silver_portfolios
  WHERE status = 'Active' GROUP BY 1),
perf AS (SELECT p.advisor_id, {avg('f.sharpe_ratio', 4)} AS sharpe, {avg('f.alpha', 4)} AS alpha
  FROM silver_portfolios p JOIN silver_performance f USING (portfolio_id) WHERE p.status = 'Active' GROUP BY 1),
deal AS (SELECT advisor_id, count(DISTINCT trade_id) AS n, sum(commission) AS comm FROM silver_trades GROUP BY 1)
SELECT {_ADVISOR_KEYS}, coalesce(book.n, 0) AS managed_portfolios, book.ytd AS avg_portfolio_ytd_return,
  perf.sharpe AS avg_sharpe_ratio, perf.alpha AS avg_alpha, coalesce(deal.n, 0) AS total_trades,
  deal.comm AS total_commissions_earned
FROM silver_advisors v LEFT JOIN book USING (advisor_id) LEFT JOIN perf USING (advisor_id)
LEFT JOIN deal USING (advisor_id) WHERE v.status = 'Active'""", _ADVISOR_DOUBLES)

gold("fee_revenue", f"""
SELECT s.fee_type, s.billing_frequency, c.client_tier, count(DISTINCT s.wm_client_id) AS client_count,
  count(*) AS schedule_count, {avg('s.fee_rate_bps', 2)} AS avg_fee_rate_bps, sum(s.last_fee_amount) AS total_fees,
  {avg('s.last_fee_amount', 2)} AS avg_fee_amount, min(s.fee_rate_bps) AS min_fee_rate_bps,
  max(s.fee_rate_bps) AS max_fee_rate_bps
FROM silver_fee_schedules s, silver_wm_clients c WHERE s.is_active AND c.wm_client_id = s.wm_client_id
GROUP BY ALL""", "avg_fee_rate_bps total_fees avg_fee_amount min_fee_rate_bps max_fee_rate_bps")

# ---- finance -----------------------------------------------------------------------------------

_MARGIN = f"""
count(*) AS account_count, sum(current_balance) AS total_balance, {avg('interest_rate', 6)} AS avg_interest_rate,
  round(sum(current_balance * interest_rate), 2) AS interest_income_est,
  {rnd(div('sum(interest_rate)', 'count(interest_rate)') + ' * 100', 4)} AS rate_pct"""
gold("net_interest_margin", f"""
SELECT account_type AS product, branch_id, {_MARGIN}, 'Deposit' AS balance_type
FROM silver_accounts WHERE account_status = 'Active' GROUP BY 1, 2
UNION ALL
SELECT loan_type, originating_branch_id, {_MARGIN}, 'Loan' FROM silver_loans GROUP BY 1, 2""",
     "total_balance avg_interest_rate interest_income_est rate_pct")

gold("capital_adequacy", """
SELECT * EXCLUDE (capital_id, created_at, source_system, silver_loaded_at),
  round(regulatory_minimum + capital_conservation_buffer + countercyclical_buffer, 4) AS fully_loaded_minimum
FROM silver_regulatory_capital""",
     "capital_amount risk_weighted_assets capital_ratio regulatory_minimum capital_conservation_buffer "
     "countercyclical_buffer fully_loaded_minimum buffer_above_minimum leverage_exposure leverage_ratio")

_HQLA = "coalesce(q.l1, 0) + coalesce(q.l2a, 0) + coalesce(q.l2b, 0)"
gold("liquidity_coverage", f"""
WITH out AS (
  SELECT {quarter('open_date')} AS quarter, sum(current_balance) AS total,
    sum(current_balance * CASE WHEN account_type IN ('CHECKING', 'SAVINGS') THEN 0.10 ELSE 0.25 END) AS stressed
  FROM silver_accounts WHERE account_status = 'Active' GROUP BY 1),
liquid AS (
  SELECT {quarter('h.as_of_date')} AS quarter,
    sum(h.market_value) FILTER (s.security_type IN ('Treasury Bond', 'Money Market')) AS l1,
    sum(h.market_value * 0.85) FILTER (s.security_type = 'Municipal Bond') AS l2a,
    sum(h.market_value * 0.5) FILTER (s.security_type = 'Corporate Bond' AND s.credit_rating IN ('AAA', 'AA')) AS l2b
  FROM silver_holdings h JOIN silver_securities s USING (security_id) GROUP BY 1)
SELECT o.quarter, o.total AS total_deposits, o.stressed AS stressed_outflows,
  coalesce(q.l1, 0) AS level_1_hqla, coalesce(q.l2a, 0) AS level_2a_hqla, coalesce(q.l2b, 0) AS level_2b_hqla,
  round({_HQLA}, 2) AS total_hqla, {ratio(_HQLA, 'o.stressed', 4)} AS lcr_ratio
FROM out o LEFT JOIN liquid q USING (quarter)""",
     "total_deposits stressed_outflows level_1_hqla level_2a_hqla level_2b_hqla total_hqla lcr_ratio")

_LATEST = "(SELECT max(reporting_date) FROM silver_regulatory_capital)"
_OVERDUE = div("count(*) FILTER (review_overdue)", "count(*)")
gold("regulatory_dashboard", f"""
SELECT 'Capital Adequacy' AS metric_category, capital_component AS metric_name, {dbl('capital_ratio')} AS metric_value,
  {dbl('regulatory_minimum')} AS threshold,
  CASE WHEN capital_ratio < regulatory_minimum THEN 'Fail' ELSE 'Pass' END AS status, reporting_date AS as_of_date
FROM silver_regulatory_capital WHERE reporting_date = {_LATEST}
UNION ALL
SELECT 'BSA/AML', 'KYC Overdue Rate - ' || risk_score_category, {dbl(rnd(_OVERDUE, 4))}, CAST(0.05 AS DOUBLE),
  CASE WHEN {_OVERDUE} > 0.05 THEN 'Fail' ELSE 'Pass' END, {BOOK_DAY}
FROM silver_kyc_records GROUP BY risk_score_category
UNION ALL
SELECT 'Filing Compliance', 'Late Filing - ' || report_name, {dbl('count(*) FILTER (filed_late)')}, CAST(0 AS DOUBLE),
  CASE WHEN bool_or(filed_late) THEN 'Fail' ELSE 'Pass' END, {BOOK_DAY}
FROM silver_regulatory_filings GROUP BY report_name""")

gold("balance_sheet_summary", f"""
SELECT 'Assets' AS category, 'Cash and Due From Banks' AS line_item,
  {dbl("round(sum(current_balance * 0.05) FILTER (account_type IN ('CHECKING', 'SAVINGS')), 0)")} AS amount
FROM silver_accounts WHERE account_status = 'Active'
UNION ALL SELECT 'Assets', 'Total Loans and Leases', {dbl('round(sum(current_balance), 0)')} FROM silver_loans
UNION ALL SELECT 'Assets', 'Investment Securities', {dbl('round(sum(market_value), 0)')} FROM silver_holdings
UNION ALL SELECT 'Liabilities', 'Total Deposits', {dbl('round(sum(current_balance), 0)')}
FROM silver_accounts WHERE account_status = 'Active'
UNION ALL SELECT 'Liabilities', 'Other Borrowed Funds', {dbl('round(sum(current_balance) * 0.15, 0)')}
FROM silver_accounts WHERE account_status = 'Active'
UNION ALL SELECT 'Equity', 'Total Equity Capital', {dbl('max(capital_amount)')}
FROM silver_regulatory_capital WHERE capital_component = 'Total Capital' AND reporting_date = {_LATEST}""")

# ---- risk --------------------------------------------------------------------------------------

_VAR_DOUBLES = ("total_exposure avg_daily_return return_volatility var_99_1d var_95_1d var_99_10d avg_duration avg_ytm")


def _var(rows: str) -> str:
    """Value at risk over joined (holding, quote) rows r with value v; the variance uses exact power sums."""
    n, s, s2 = dbl("count(r)"), dbl("sum(r)"), dbl("sum(r * r)")
    sd = f"CASE WHEN count(r) > 1 THEN sqrt(greatest(({n} * {s2} - {s} * {s}) / ({n} * ({n} - 1)), 0)) END"
    at_risk = f"({dbl('sum(v)')} * {sd})"
    return f"""
SELECT asset_class, sector, count(DISTINCT security_id) AS position_count, sum(v) AS total_exposure,
  {avg('r', 6)} AS avg_daily_return, {rnd(sd, 6)} AS return_volatility,
  {rnd(at_risk + ' * CAST(2.326 AS DOUBLE)', 2)} AS var_99_1d,
  {rnd(at_risk + ' * CAST(1.645 AS DOUBLE)', 2)} AS var_95_1d,
  {rnd(at_risk + ' * CAST(2.326 AS DOUBLE) * sqrt(CAST(10 AS DOUBLE))', 2)} AS var_99_10d,
  {avg('duration', 2)} AS avg_duration, {avg('yield_to_maturity', 4)} AS avg_ytm
FROM ({rows}) GROUP BY 1, 2"""


gold("market_risk_var", _var("""
SELECT h.asset_class, h.sector, h.security_id, h.market_value AS v, m.daily_return AS r, m.duration, m.yield_to_maturity
FROM silver_holdings h LEFT JOIN silver_market_data m USING (security_id)"""), _VAR_DOUBLES)
gold("market_risk_var_grain_safe", _var("""
SELECT asset_class, sector, security_id, market_value AS v, NULL::DECIMAL(10,4) AS r, NULL::DECIMAL(12,6) AS duration,
  NULL::DECIMAL(12,6) AS yield_to_maturity FROM silver_holdings
UNION ALL
SELECT p.asset_class, p.sector, p.security_id, NULL, m.daily_return, m.duration, m.yield_to_maturity
FROM (SELECT DISTINCT asset_class, sector, security_id FROM silver_holdings) p
JOIN silver_market_data m USING (security_id)"""), _VAR_DOUBLES)

_FAILED = "count(*) FILTER (e.result = 'Failed')"
_OP_KEYS = f"{month('e.event_timestamp')} AS event_month, e.system_name, e.event_type"
gold("operational_risk", f"""
SELECT {_OP_KEYS}, count(*) AS event_count, {_FAILED} AS failed_count, {pct(_FAILED, 'count(*)')} AS failure_rate_pct,
  count(*) FILTER (e.sox_relevant) AS sox_relevant_count, count(DISTINCT e.user_id) AS unique_users,
  count(DISTINCT e.source_ip) AS unique_ips, count(DISTINCT p.case_id) AS compliance_cases
FROM silver_audit_events e
LEFT JOIN silver_compliance_cases p ON {month('e.event_timestamp')} = {month('p.opened_date')}
GROUP BY 1, 2, 3""", "failure_rate_pct")
gold("operational_risk_grain_safe", f"""
SELECT {_OP_KEYS}, count(*) AS event_count, {_FAILED} AS failed_count, {pct(_FAILED, 'count(*)')} AS failure_rate_pct,
  count(*) FILTER (e.sox_relevant) AS sox_relevant_count, count(DISTINCT e.user_id) AS unique_users,
  count(DISTINCT e.source_ip) AS unique_ips,
  coalesce(any_value((SELECT count(*) FROM silver_compliance_cases p
    WHERE {month('p.opened_date')} = {month('e.event_timestamp')})), 0) AS compliance_cases
FROM silver_audit_events e GROUP BY 1, 2, 3""", "failure_rate_pct")
