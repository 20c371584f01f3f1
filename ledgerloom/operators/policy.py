"""Column-level masking by sensitivity tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sensitivity levels from most to least sensitive, and the tagged columns of each table.
LEVELS = ("highly-sensitive", "sensitive", "confidential", "internal")
PERSON = ("first_name", "last_name", "email", "phone", "address_line1")
TAGS: dict[str, dict[str, str]] = {
    "bronze_customers": {"ssn": "highly-sensitive", "date_of_birth": "highly-sensitive"}
    | dict.fromkeys(PERSON, "sensitive"),
    "silver_customers": {"ssn_masked": "highly-sensitive", "date_of_birth": "highly-sensitive"}
    | dict.fromkeys(PERSON, "sensitive"),
    "gold_customer_360": dict.fromkeys(("first_name", "last_name"), "sensitive")
    | dict.fromkeys(("total_aum", "total_relationship_value"), "confidential"),
    "bronze_wm_clients": dict.fromkeys(("first_name", "last_name", "email", "phone"), "sensitive")
    | {"total_aum": "confidential"},
    "silver_wm_clients": dict.fromkeys(("first_name", "last_name"), "sensitive") | {"total_aum": "confidential"},
    "bronze_loans": {"fico_score_at_origination": "confidential"},
    "silver_loans": {"fico_score_at_origination": "confidential"},
    "bronze_credit_cards": {"apr": "confidential"},
    "silver_credit_cards": {"apr": "confidential"},
    "bronze_accounts": {"current_balance": "confidential"},
    "silver_accounts": {"current_balance": "confidential"},
}


def _masked(c: str, tag: str, df: DataFrame, key: str) -> Column:
    kind = df.schema[c].dataType
    if tag == "sensitive":
        # The same value keeps the same token. Names and phones are few enough to guess, so the digest is keyed twice.
        inner = F.sha2(F.concat(F.lit(key), F.col(c).cast("string")), 256)
        return F.sha2(F.concat(F.lit(key), inner), 256)
    return F.lit(None).cast(kind)


def apply_policy(df: DataFrame, table: str, clearance: str, key: str) -> DataFrame:
    """Mask every tagged column above the reader's clearance.

    Personal names and contacts become tokens that still join; identifiers and
    financial figures become NULL. `key` is the secret of the tokens. Tags travel in the column metadata.
    """
    tags = TAGS.get(table, {})
    allowed = LEVELS.index(clearance)
    columns = []
    for c in df.columns:
        tag = tags.get(c)
        value = _masked(c, tag, df, key) if tag and LEVELS.index(tag) < allowed else F.col(c)
        columns.append(value.alias(c, metadata={"sensitivity": tag}) if tag else value.alias(c))
    return df.select(columns)
