"""The full build: silver is written once, gold reads what was written."""

from __future__ import annotations

from collections.abc import Iterable

from ledgerloom.functions.scalars import month_of
from ledgerloom.plans.gold import GOLD
from ledgerloom.plans.governance import GOLD_INPUTS
from ledgerloom.plans.silver import SILVER
from ledgerloom.sources.lake import Lake
from ledgerloom.sources.warehouse import Warehouse

# Facts are stored by month, so a query over a period opens only its folders.
FACT_DATES = {
    "transactions": "transaction_date",
    "loan_payments": "payment_date",
    "holdings": "as_of_date",
    "trades": "trade_date",
    "market_data": "as_of_date",
    "performance": "as_of_date",
    "gl_entries": "posting_date",
    "audit_events": "event_timestamp",
}
MONTH = "event_month"


def build(lake: Lake, warehouse: Warehouse, gold: Iterable[str] = tuple(GOLD)) -> list[str]:
    """Write the silver tables the gold tables need, then gold; returns the tables written."""
    gold = list(gold)
    needed = [s for s in SILVER if any(s in GOLD_INPUTS[g] for g in gold)]
    for name in needed:
        rows = lake.silver(name)
        date = FACT_DATES.get(name)
        if date:
            # rows of a month come together; the rebalance splits a heavy month and joins light ones by measured size
            rows = rows.withColumn(MONTH, month_of(date)).hint("rebalance", MONTH)
        stored = warehouse.replace("silver", name, rows, MONTH if date else None)
        lake.pin(f"silver_{name}", stored.drop(MONTH))
    for name in gold:
        lake.pin(f"gold_{name}", warehouse.replace("gold", name, GOLD[name](lake)))
    return [f"silver.{n}" for n in needed] + [f"gold.{n}" for n in gold]
