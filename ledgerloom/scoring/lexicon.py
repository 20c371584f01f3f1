"""Word lists, patterns and evaluation cases of the response scoring."""

from __future__ import annotations

from dataclasses import dataclass

from ledgerloom.plans.gold import GOLD
from ledgerloom.plans.silver import SILVER
from ledgerloom.sources.bindings import BINDINGS

# Fixed values ----------------------------------------------------------------------------------
GLOSSARY_KEYWORDS = {
    "FICO Score": ("fico", "credit score", "fair isaac"),
    "AUM": ("aum", "assets under management"),
    "SAR": ("sar", "suspicious activity"),
    "CET1 Ratio": ("cet1", "common equity tier", "capital ratio"),
    "Customer ID": ("customer_id", "customer id", "customer identifier"),
    "Delinquency": ("delinquen", "past due", "overdue"),
    "KYC": ("kyc", "know your customer"),
    "VaR": ("var", "value at risk"),
    "CUSIP": ("cusip",),
    "Branch": ("branch",),
    "NIM": ("nim", "net interest margin"),
    "Risk Rating": ("risk rating", "risk_rating", "credit quality"),
}
METADATA_PATTERNS = {
    "data_quality": ("data quality", "quality score", "quality rule", "dq ", "validation", "trustworth"),
    "lineage": ("lineage", "source system", "atlas", "fortuna", "argus", "db2", "mainframe", "bronze.*silver.*gold",
                "medallion"),
    "regulatory": ("basel", "regulatory", "compliance", "fdic", "bsa", "aml requirement"),
    "classification": ("classification", "pii", "sensitive", "restricted", "confidential"),
}
FAILURE_MARKERS = (
    "i don't have", "i do not have", "cannot answer", "can't answer",
    "don't have access", "not available", "outside my", "beyond my",
    "unable to", "i lack", "no table", "not in my", "don't have the",
    "insufficient", "would need", "requires access to",
)
MENTIONED_TERMS = {
    "fico": ("FICO Score",), "cusip": ("CUSIP",), "isin": ("ISIN",),
    "aum": ("AUM",), "sar": ("SAR",), "bsa": ("SAR", "BSA"),
    "aml": ("AML",), "anti-money": ("AML",), "money laundering": ("AML",),
    "cet1": ("CET1 Ratio",), "capital": ("CET1 Ratio",),
    "kyc": ("KYC",), "delinquen": ("Delinquency",),
    "customer": ("Customer ID",), "branch": ("Branch",),
    "nim": ("NIM",), "interest rate": ("NIM",),
    "var": ("VaR",), "risk": ("Risk Rating",),
}
CONTEXT_MARKERS = ("because", "this means", "indicates", "suggests", "notably", "compared")
CATALOG_MARKERS = (
    "knowledge catalog", "glossary", "data quality", "lineage", "source system", "atlas", "fortuna", "argus",
    "classification", "sensitivity", "medallion", "governance", "search_entries",
)
PROBLEM_MARKERS = ("error", "unable", "cannot")
DOLLARS = r"\$[0-9,]+(?:\.[0-9]+)?"
PERCENTAGES = r"[0-9]+\.?[0-9]*\s*%"
LONG_NUMBER = r"[0-9]{3,}"
SECTIONS = ("(?i)data discovery", "(?i)analysis", "(?i)data governance", "(?i)recommend")

VIEW_NAMES = (
    "vw_customer_total_relationship", "vw_branch_retail_wealth", "vw_regulatory_summary", "vw_dq_scorecard",
    "vw_dq_by_dimension", "vw_dq_failed_rules", "vw_dq_rule_detail", "vw_profile_summary",
)
TABLE_NAMES = tuple(
    sorted([f"bronze_{n}" for n in BINDINGS] + [f"silver_{n}" for n in SILVER] + [f"gold_{n}" for n in GOLD]
           + list(VIEW_NAMES)))
TABLE_PREFIXES = ("bronze_", "silver_", "gold_", "vw_")


@dataclass(frozen=True)
class Expected:
    """What one agent's answer to a question should hold; `lineage` asks for a citation of lineage as well."""

    outcome: str
    tables: tuple[str, ...] = ()
    wrong_tables: tuple[str, ...] = ()
    glossary: tuple[str, ...] = ()
    metadata: tuple[str, ...] = ()
    lineage: bool = False

    @property
    def cited(self) -> tuple[str, ...]:
        return (*self.metadata, "lineage") if self.lineage and "lineage" not in self.metadata else self.metadata


@dataclass(frozen=True)
class Case:
    """One evaluation question and what each agent is expected to make of it."""

    name: str
    complexity: str
    basic: Expected
    scaled: Expected
    kc: Expected


FAILS, PARTIAL = Expected("fail_gracefully"), Expected("partial")


def _all_succeed(table: str, *glossary: str) -> tuple[Expected, Expected, Expected]:
    plain = Expected("success", (table,))
    return plain, plain, Expected("success", (table,), glossary=glossary)


# The evaluation cases.
CASES = (
    Case("top_customers", "simple", *_all_succeed("gold_customer_360", "Customer ID")),
    Case("loan_portfolio_summary", "simple", *_all_succeed("gold_loan_portfolio_summary", "Risk Rating")),
    Case("balance_sheet_overview", "simple", *_all_succeed("gold_balance_sheet_summary")),
    Case("portfolio_performance", "simple", *_all_succeed("gold_portfolio_performance")),
    Case("suspicious_activity_trends", "ambiguous", FAILS,
         Expected("partial", wrong_tables=("bronze_fraud_alerts", "silver_fraud_alerts", "bronze_compliance_cases")),
         Expected("success", ("gold_fraud_analytics", "gold_aml_risk_scoring", "silver_fraud_alerts"), glossary=("SAR",))),
    Case("interest_rate_exposure", "ambiguous", FAILS, Expected("partial", wrong_tables=("bronze_interest_rates",)),
         Expected("success", ("gold_net_interest_margin", "gold_balance_sheet_summary"), glossary=("NIM",))),
    Case("customer_risk_overview", "ambiguous", PARTIAL, Expected("partial", wrong_tables=("bronze_risk_exposures", "bronze_risk_profiles")),
         Expected("success", ("gold_customer_360", "gold_aml_risk_scoring"), glossary=("Risk Rating", "KYC"))),
    Case("delinquency_trends", "ambiguous", PARTIAL, Expected("partial", wrong_tables=("silver_loans", "bronze_loans")),
         Expected("success", ("gold_delinquency_analysis", "gold_loan_portfolio_summary"), glossary=("Delinquency",))),
    Case("branch_performance_full", "multi_table", FAILS, PARTIAL, Expected("success", ("gold_branch_performance",), glossary=("Branch",))),
    Case("advisor_revenue_analysis", "multi_table", FAILS, PARTIAL, Expected("success", ("gold_advisor_scorecard", "gold_client_revenue"))),
    Case("aml_investigation", "multi_table", FAILS, PARTIAL,
         Expected("success", ("gold_aml_risk_scoring", "gold_customer_360"), glossary=("KYC", "SAR"))),
    Case("operational_risk_audit", "multi_table", FAILS, PARTIAL, Expected("success", ("gold_operational_risk",), lineage=True)),
    Case("hnw_total_exposure", "cross_domain", Expected("success", ("gold_customer_360",)), PARTIAL,
         Expected("success", ("gold_customer_360",), glossary=("AUM", "Customer ID"), lineage=True)),
    Case("branch_retail_wealth_revenue", "cross_domain", FAILS, PARTIAL,
         Expected("success", ("gold_branch_performance", "gold_client_revenue"), glossary=("Branch",))),
    Case("customer_product_penetration", "cross_domain", Expected("partial", ("gold_customer_360",)), PARTIAL,
         Expected("success", ("gold_customer_360",), glossary=("Customer ID", "AUM"))),
    Case("cross_sell_opportunities", "cross_domain", Expected("partial", ("gold_customer_360",)), PARTIAL, Expected("success", ("gold_customer_360",))),
    Case("fico_trust", "governance_dependent", PARTIAL, PARTIAL,
         Expected("success", ("gold_loan_portfolio_summary",), glossary=("FICO Score",), metadata=("data_quality",))),
    Case("cusip_data_quality", "governance_dependent", FAILS, PARTIAL, Expected("success", glossary=("CUSIP",), metadata=("data_quality",))),
    Case("basel_capital_requirements", "governance_dependent", FAILS, Expected("partial", wrong_tables=("bronze_regulatory_capital",)),
         Expected("success", ("gold_capital_adequacy",), glossary=("CET1 Ratio",), metadata=("regulatory",))),
    Case("data_lineage_question", "governance_dependent", FAILS, FAILS, Expected("success", metadata=("lineage",), lineage=True)),
    Case("cre_stress_test", "impossible_without_metadata", FAILS, PARTIAL,
         Expected("success", ("gold_capital_adequacy", "gold_loan_portfolio_summary"), glossary=("CET1 Ratio",), lineage=True)),
    Case("market_risk_var_analysis", "impossible_without_metadata", PARTIAL, PARTIAL,
         Expected("success", ("gold_market_risk_var",), glossary=("VaR",), metadata=("data_quality",))),
    Case("liquidity_coverage_ratio", "impossible_without_metadata", FAILS, PARTIAL, Expected("success", ("gold_liquidity_coverage",))),
    Case("regulatory_filing_readiness", "impossible_without_metadata", FAILS, PARTIAL,
         Expected("success", ("gold_regulatory_dashboard", "silver_regulatory_filings", "bronze_regulatory_filings", "gold_capital_adequacy"),
                  lineage=True)),
)
AGENTS = ("basic", "scaled", "kc")


def expectations() -> list[tuple]:
    """(case number, agent, complexity, outcome, right tables, wrong tables, terms, kinds of metadata), one for each case and agent."""
    return [
        (no, agent, case.complexity, e.outcome, e.tables, e.wrong_tables, e.glossary, e.cited)
        for no, case in enumerate(CASES) for agent in AGENTS for e in [getattr(case, agent)]]
