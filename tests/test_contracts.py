"""Bronze contracts, lineage and masking guarantees."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.gold import GOLD
from ledgerloom.plans.governance import GOLD_INPUTS, asset_sources, impact, lineage_edges
from ledgerloom.plans.silver import SILVER
from ledgerloom.sources.bindings import BINDINGS, INJECTIONS

TEXT = (Path(__file__).parent.parent / "FIXTURES.md").read_text()
CONTRACTS = {
    m[1]: [tuple(c.split()[:2]) for c in m[2].split(", ")]
    for m in re.finditer(r"^- \*\*bronze_(\w+)\*\* \([^)]*\): (.*)$", TEXT, re.M)}
TYPES = {"STRING": "string", "BIGINT": "bigint", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_bronze_follows_its_contract(lake, name):
    got = dict(lake.bronze(name).dtypes)
    assert list(got) == [c for c, _ in CONTRACTS[name]]
    for column, kind in CONTRACTS[name]:
        if kind == "DOUBLE":
            assert got[column].startswith("decimal") or got[column] == "double", column
        else:
            assert got[column] == TYPES[kind], column


def test_forty_tables_each():
    assert len(BINDINGS) == len(SILVER) == len(CONTRACTS) == 40
    assert set(BINDINGS) == set(SILVER) == set(CONTRACTS)


def test_injections_use_contract_columns_only():
    for table, spec in INJECTIONS.items():
        assert set(spec.values) <= set(BINDINGS[table].columns)


def test_lineage_covers_every_gold_table(spark):
    assert set(GOLD_INPUTS) == set(GOLD)
    edges = lineage_edges(spark)
    assert edges.count() == 80 + sum(len(v) for v in GOLD_INPUTS.values())
    hit = {r.descendant for r in impact(spark, "bronze_loans").collect()}
    assert {"silver_loans", "gold_customer_360", "gold_balance_sheet_summary"} <= hit
    assert "gold_fraud_analytics" not in hit


def test_products_point_at_known_tables():
    assert {s for *_, s in asset_sources()} <= set(SILVER)
    assert len({(p, a) for p, a, *_ in asset_sources()}) == 23


def test_no_unmasked_number_survives_in_silver(lake):
    for table, column in (("customers", "ssn_masked"), ("customers", "tin_masked"), ("wm_clients", "tax_id_masked")):
        leaked = lake.silver(table).where(F.col(column).rlike(r"\d{3}-?\d{2}-?\d{4}"))
        assert leaked.isEmpty()
        assert "ssn" not in lake.silver(table).columns
