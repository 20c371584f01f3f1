"""SQL twins of the views, the analyst workload and the business questions."""

from __future__ import annotations

from ledgerloom.oracle.gold import DOUBLES
from ledgerloom.oracle.layers import dbl, define, quarter_end, ratio, silver_published
from ledgerloom.plans.views import RELATIONSHIP_TIERS
from ledgerloom.plans.workload import FICO_BANDS

QUERIES: dict[str, str] = {}


def tiers(value: str, lower_bounds: tuple, rest: str) -> str:
    """The name of the first lower bound that a value reaches."""
    return "CASE " + " ".join(f"WHEN {value} >= {low} THEN '{name}'" for low, name in lower_bounds) + f" ELSE '{rest}' END"


# ---- views -------------------------------------------------------------------------------------

define("vw_customer_total_relationship", f"""
SELECT * EXCLUDE (customer_type, home_branch_id, kyc_risk_rating, kyc_status, account_opened_date, state, industry,
    total_accounts, total_loans, total_cards, wm_client_id),
  {tiers('total_relationship_value', RELATIONSHIP_TIERS, 'Mass Market')} AS relationship_tier
FROM gold_customer_360""")
QUERIES["vw_customer_total_relationship"] = "SELECT * REPLACE (" + ", ".join(
    f"{dbl(c)} AS {c}" for c in DOUBLES["gold_customer_360"]) + ") FROM vw_customer_total_relationship"

for _name, _book in (
    ("vw_branch_retail_wealth", "SELECT advisor_id AS branch_id, market_value, wm_client_id FROM silver_portfolios"),
    ("vw_branch_retail_wealth_fixed", "SELECT v.office_branch_id AS branch_id, p.market_value, p.wm_client_id "
                                      "FROM silver_portfolios p JOIN silver_advisors v USING (advisor_id)"),
):
    QUERIES[_name] = f"""
SELECT b.branch_id, b.branch_name, b.city, b.state, b.region, {dbl('b.total_deposits')} AS retail_deposits,
  {dbl('b.total_loan_balance')} AS retail_loans, b.total_accounts AS retail_accounts, b.transaction_volume,
  {dbl('coalesce(sum(w.market_value), 0)')} AS wealth_aum, count(DISTINCT w.wm_client_id) AS wealth_clients,
  {dbl('b.total_deposits + coalesce(sum(w.market_value), 0)')} AS combined_assets
FROM gold_branch_performance b LEFT JOIN ({_book}) w USING (branch_id)
GROUP BY b.branch_id, b.branch_name, b.city, b.state, b.region, b.total_deposits, b.total_loan_balance,
  b.total_accounts, b.transaction_volume"""

QUERIES["vw_regulatory_summary"] = "SELECT * FROM gold_regulatory_dashboard"

# ---- workload ----------------------------------------------------------------------------------


def pick(table: str, columns: str, tail: str = "") -> str:
    doubles = DOUBLES.get(table, ())
    cols = ", ".join(f"{dbl(c)} AS {c}" if c in doubles else c for c in columns.split())
    return f"SELECT {cols} FROM {table} {tail}"


def top(table: str, n: int, by: str, ties: str, columns: str, where: str = "") -> str:
    keys = ", ".join(f"{t} ASC NULLS LAST" for t in ties.split())
    inner = f"(SELECT * FROM {table} {where} ORDER BY {by} DESC NULLS LAST, {keys} LIMIT {n})"
    doubles = DOUBLES.get(table, ("total_aum",))
    cols = ", ".join(f"{dbl(c)} AS {c}" if c in doubles else c for c in columns.split())
    return f"SELECT {cols} FROM {inner}"


QUERIES["wq_customer_lookup"] = silver_published("customers") + " WHERE customer_id = 'CUST-00000042'"
QUERIES["wq_top_depositors"] = top(
    "gold_customer_360", 20, "total_deposit_balance", "customer_id wm_client_id",
    "customer_id customer_segment total_deposit_balance")
QUERIES["wq_account_dormancy"] = (
    "SELECT account_type, count(*) AS cnt FROM gold_account_summary WHERE is_dormant GROUP BY 1")
QUERIES["wq_account_dormancy_fixed"] = (
    "SELECT account_type, count(*) AS cnt FROM gold_account_summary_dormancy_fixed WHERE is_dormant GROUP BY 1")
QUERIES["wq_branch_performance"] = top(
    "gold_branch_performance", 20, "total_deposits", "branch_id",
    "branch_name region total_deposits total_loans deposits_per_employee")
QUERIES["wq_transaction_patterns"] = top(
    "gold_transaction_patterns", 20, "total_amount", "month channel merchant_category transaction_type",
    "channel merchant_category transaction_count total_amount", "WHERE month >= DATE '2001-01-01'")
QUERIES["wq_loan_portfolio"] = pick(
    "gold_loan_portfolio_summary", "loan_type risk_rating loan_count total_outstanding delinquency_rate_pct")
QUERIES["wq_delinquency_by_type"] = pick(
    "gold_delinquency_analysis", "loan_type delinquency_status loan_count total_balance")
QUERIES["wq_fico_distribution"] = f"""
SELECT {tiers('fico_score_at_origination', FICO_BANDS, '<580')} AS fico_band, count(*) AS cnt FROM silver_loans GROUP BY 1"""
QUERIES["wq_cre_concentration"] = pick(
    "gold_delinquency_analysis", "industry_naics loan_count total_balance", "WHERE loan_type = 'COMMERCIAL'")
QUERIES["wq_client_aum"] = top(
    "silver_wm_clients", 20, "total_aum", "wm_client_id", "wm_client_id first_name last_name client_tier total_aum")
QUERIES["wq_portfolio_performance"] = top(
    "gold_portfolio_performance", 20, "market_value", "portfolio_id",
    "portfolio_name market_value ytd_return avg_sharpe_ratio avg_alpha")
QUERIES["wq_advisor_scorecard"] = top(
    "gold_advisor_scorecard", 10, "total_aum", "advisor_id",
    "first_name last_name total_aum client_count avg_portfolio_ytd_return avg_sharpe_ratio")
QUERIES["wq_asset_allocation"] = pick(
    "gold_asset_allocation", "asset_class sector total_market_value avg_return_pct")
QUERIES["wq_fee_revenue"] = pick("gold_fee_revenue", "fee_type client_tier total_fees avg_fee_rate_bps")
QUERIES["wq_fraud_trends"] = pick(
    "gold_fraud_analytics", "alert_month alert_type alert_count confirmed_fraud_count false_positive_rate_pct")
QUERIES["wq_aml_risk"] = pick(
    "gold_aml_risk_scoring", "customer_segment kyc_risk_rating customer_count avg_risk_score sar_filings")
QUERIES["wq_kyc_overdue"] = """
SELECT due_diligence_level, risk_score_category, count(*) AS total, count(*) FILTER (review_overdue) AS overdue
FROM silver_kyc_records GROUP BY ALL"""
QUERIES["wq_large_wires"] = f"""
SELECT wire_type, beneficiary_country, count(*) AS cnt, {dbl('sum(amount)')} AS total
FROM silver_wire_transfers WHERE above_ctr_threshold GROUP BY 1, 2"""
QUERIES["wq_regulatory_dashboard"] = "SELECT * EXCLUDE (as_of_date) FROM gold_regulatory_dashboard"
QUERIES["wq_nim_by_product"] = pick(
    "gold_net_interest_margin", "product balance_type total_balance avg_interest_rate")
QUERIES["wq_capital_adequacy"] = pick(
    "gold_capital_adequacy", "reporting_date capital_component capital_ratio regulatory_minimum buffer_above_minimum")
QUERIES["wq_balance_sheet"] = "SELECT * FROM gold_balance_sheet_summary"
QUERIES["wq_market_risk_var"] = pick(
    "gold_market_risk_var", "asset_class sector total_exposure var_99_1d var_99_10d")
QUERIES["wq_total_relationship"] = f"""
SELECT relationship_tier, count(*) AS cnt, {dbl('sum(total_relationship_value)')} AS total_value
FROM vw_customer_total_relationship GROUP BY 1"""

# ---- business questions ------------------------------------------------------------------------

define("rule_per_customer", """
SELECT c.customer_id, c.first_name, c.last_name, c.customer_segment, a.bal AS deposits,
  coalesce(l.bal, 0) AS loans, coalesce(w.aum, 0) AS aum,
  coalesce(a.bal, 0) + coalesce(k.credit, 0) + coalesce(w.aum, 0) AS total_relationship_value,
  (a.customer_id IS NOT NULL)::INT + (l.customer_id IS NOT NULL)::INT + (k.customer_id IS NOT NULL)::INT
    + (w.customer_id IS NOT NULL)::INT AS products
FROM silver_customers c
LEFT JOIN (SELECT customer_id, sum(current_balance) bal FROM silver_accounts WHERE account_status = 'Active'
  GROUP BY 1) a USING (customer_id)
LEFT JOIN (SELECT customer_id, sum(current_balance) bal FROM silver_loans GROUP BY 1) l USING (customer_id)
LEFT JOIN (SELECT customer_id, sum(available_credit) credit FROM silver_credit_cards WHERE card_status = 'Active'
  GROUP BY 1) k USING (customer_id)
LEFT JOIN (SELECT retail_customer_id AS customer_id, sum(total_aum) aum FROM silver_wm_clients
  WHERE retail_customer_id IS NOT NULL GROUP BY 1) w USING (customer_id)""")
_BEST = "ORDER BY total_relationship_value DESC, customer_id LIMIT"
QUERIES["bq_top5_relationship"] = f"""
SELECT customer_id, first_name, last_name, customer_segment, {dbl('total_relationship_value')} AS
  total_relationship_value FROM (SELECT * FROM rule_per_customer {_BEST} 5)"""
QUERIES["bq_product_penetration"] = f"""
SELECT customer_id, customer_segment, {dbl('total_relationship_value')} AS total_relationship_value,
  CAST(products AS BIGINT) AS product_count FROM (SELECT * FROM rule_per_customer {_BEST} 20)"""
QUERIES["bq_hnw_total_exposure"] = f"""
SELECT customer_segment, count(*) AS customers, {dbl('coalesce(sum(deposits), 0)')} AS deposits,
  {dbl('sum(loans)')} AS loans, {dbl('sum(aum)')} AS investments,
  {dbl('sum(coalesce(deposits, 0) + loans + aum)')} AS total_exposure
FROM rule_per_customer WHERE customer_segment IN ('Premier', 'Private Banking') GROUP BY 1"""
QUERIES["bq_branch_combined_revenue"] = f"""
WITH r AS (SELECT branch_id, sum(interest_income_est) AS v FROM gold_net_interest_margin
  WHERE balance_type = 'Loan' GROUP BY 1),
w AS (SELECT v.office_branch_id AS branch_id, count(*) AS n, sum(g.total_revenue) AS v
  FROM gold_client_revenue_grain_safe g JOIN silver_advisors v ON v.advisor_id = g.primary_advisor_id GROUP BY 1)
SELECT b.branch_id, b.branch_name, {dbl('b.total_deposits')} AS total_deposits,
  {dbl('coalesce(r.v, 0)')} AS retail_revenue, coalesce(w.n, 0) AS wealth_clients,
  {dbl('coalesce(w.v, 0)')} AS wealth_revenue, {dbl('coalesce(r.v, 0) + coalesce(w.v, 0)')} AS combined_revenue
FROM gold_branch_performance_grain_safe b LEFT JOIN r USING (branch_id) LEFT JOIN w USING (branch_id)"""
QUERIES["bq_kyc_gaps"] = f"""
SELECT k.kyc_id, k.customer_id, k.due_diligence_level, k.next_review_date, c.customer_segment, c.kyc_status,
  count(w.wire_id) AS wires, {dbl('coalesce(sum(w.amount), 0)')} AS wire_amount,
  count(*) FILTER (w.amount >= 10000) AS large_wires
FROM silver_kyc_records k JOIN silver_customers c USING (customer_id)
LEFT JOIN silver_wire_transfers w ON w.originator_customer_id = c.customer_id
WHERE k.review_overdue AND c.kyc_risk_rating = 'High' GROUP BY ALL"""
QUERIES["bq_cross_sell_mortgage"] = f"""
SELECT 'Mortgage for wealth client' AS opportunity, retail_customer_id AS customer_id, wm_client_id,
  {dbl('total_aum')} AS total_aum
FROM silver_wm_clients w WHERE total_aum >= 1000000 AND retail_customer_id IS NOT NULL
  AND NOT EXISTS (FROM silver_loans l WHERE l.customer_id = w.retail_customer_id AND l.loan_type = 'MORTGAGE')
UNION ALL
SELECT 'Wealth portfolio for private banking', customer_id, NULL, NULL FROM silver_customers c
WHERE customer_segment = 'Private Banking' AND NOT EXISTS (
  FROM silver_wm_clients w JOIN silver_portfolios p USING (wm_client_id) WHERE w.retail_customer_id = c.customer_id)"""
QUERIES["bq_cre_stress"] = f"""
WITH s AS (SELECT sum(current_balance) AS bal, round(sum(current_balance) * 0.0225, 2) AS loss
  FROM silver_loans WHERE loan_type = 'COMMERCIAL')
SELECT capital_component, {dbl('capital_amount')} AS capital_amount,
  {dbl('risk_weighted_assets')} AS risk_weighted_assets, {dbl('s.bal')} AS cre_balance, {dbl('s.loss')} AS stressed_loss,
  {dbl('capital_amount - s.loss')} AS stressed_capital,
  {dbl(ratio('capital_amount', 'risk_weighted_assets', 4))} AS base_ratio,
  {dbl(ratio('capital_amount - s.loss', 'risk_weighted_assets', 4))} AS stressed_ratio
FROM silver_regulatory_capital, s
WHERE reporting_date = (SELECT max(reporting_date) FROM silver_regulatory_capital)"""
QUERIES["bq_filing_readiness"] = f"""
WITH f AS (SELECT {quarter_end('reporting_period_end')} AS quarter, count(*) AS filings,
    count(actual_filing_date) AS filed, count(*) FILTER (filed_late) AS late
  FROM silver_regulatory_filings GROUP BY 1),
s AS (SELECT reporting_date AS quarter, count(*) AS n, sum(CAST(amount AS DECIMAL(28,0))) AS amt
  FROM staging_call_report_rc GROUP BY 1)
SELECT quarter, filings, filed, late, coalesce(n, 0) AS staged_lines, {dbl('amt')} AS staged_amount,
  filed = filings AND coalesce(n, 0) > 0 AS ready
FROM f LEFT JOIN s USING (quarter)"""
