"""Gold: the business aggregates over silver."""

from __future__ import annotations

from ledgerloom.plans.gold.customers import (
    account_summary,
    account_summary_dormancy_fixed,
    aml_risk_scoring,
    branch_performance,
    customer_360,
    transaction_patterns,
)
from ledgerloom.plans.gold.finance import (
    balance_sheet_summary,
    capital_adequacy,
    liquidity_coverage,
    net_interest_margin,
    regulatory_dashboard,
)
from ledgerloom.plans.gold.lending import delinquency_analysis, fraud_analytics, loan_portfolio_summary
from ledgerloom.plans.gold.risk import market_risk_var, operational_risk
from ledgerloom.plans.gold.wealth import (
    advisor_scorecard,
    asset_allocation,
    client_revenue,
    fee_revenue,
    portfolio_performance,
)

GOLD = {
    "customer_360": customer_360,
    "account_summary": account_summary,
    "transaction_patterns": transaction_patterns,
    "loan_portfolio_summary": loan_portfolio_summary,
    "delinquency_analysis": delinquency_analysis,
    "fraud_analytics": fraud_analytics,
    "aml_risk_scoring": aml_risk_scoring,
    "branch_performance": branch_performance,
    "portfolio_performance": portfolio_performance,
    "client_revenue": client_revenue,
    "asset_allocation": asset_allocation,
    "advisor_scorecard": advisor_scorecard,
    "fee_revenue": fee_revenue,
    "net_interest_margin": net_interest_margin,
    "capital_adequacy": capital_adequacy,
    "liquidity_coverage": liquidity_coverage,
    "market_risk_var": market_risk_var,
    "operational_risk": operational_risk,
    "regulatory_dashboard": regulatory_dashboard,
    "balance_sheet_summary": balance_sheet_summary,
}

# Variants: children counted once, and the dormancy test over the whole history.
VARIANTS = {
    "customer_360_grain_safe": lambda lake: customer_360(lake, repeat=False),
    "aml_risk_scoring_grain_safe": lambda lake: aml_risk_scoring(lake, repeat=False),
    "branch_performance_grain_safe": lambda lake: branch_performance(lake, repeat=False),
    "portfolio_performance_grain_safe": portfolio_performance,
    "client_revenue_grain_safe": lambda lake: client_revenue(lake, repeat=False),
    "advisor_scorecard_grain_safe": lambda lake: advisor_scorecard(lake, repeat=False),
    "market_risk_var_grain_safe": lambda lake: market_risk_var(lake, repeat=False),
    "operational_risk_grain_safe": lambda lake: operational_risk(lake, repeat=False),
    "account_summary_dormancy_fixed": account_summary_dormancy_fixed,
}
