"""What the planner makes of the queries."""

from __future__ import annotations

import contextlib
import io

import pytest

from ledgerloom import query_catalog
from tests.conftest import SMALL

QUERIES = {n: q for n, q in query_catalog().items() if not n.startswith(("st_", "hierarchy_"))}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join_and_no_python_in_the_plan(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert not [f for f in FORBIDDEN if f in text]


def test_dedupe_limits_groups_below_the_shuffle(spark):
    text = plan(QUERIES["silver_loans"](spark, SMALL))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_scan_reads_only_the_columns_needed(spark):
    text = plan(QUERIES["wq_large_wires"](spark, SMALL))
    scan = [line for line in text.splitlines() if line.startswith("ReadSchema") and "l_" in line]
    assert scan and all("l_shipdate" not in line and "l_tax" not in line for line in scan)
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in text


def test_period_filter_reaches_the_event_scan(spark):
    text = plan(QUERIES["ev_event_counts"](spark, SMALL))
    assert "GreaterThan(ts," in text


def test_positions_are_summed_before_they_are_spread_over_the_quarters(spark):
    tree = plan(QUERIES["snapshot_quarterly_positions"](spark, SMALL)).split("\n\n")[0]
    assert 0 < tree.index("Generate") < tree.index("HashAggregate")


def test_a_table_with_bad_rows_is_read_and_joined_once(spark):
    tree = plan(QUERIES["dirty_wires"](spark, SMALL)).split("\n\n")[0]
    assert tree.count("Scan parquet") == 2 and "Union" not in tree


def test_allocation_does_not_repeat_holdings_for_its_distinct_counts(spark):
    assert "Expand" not in plan(QUERIES["gold_asset_allocation"](spark, SMALL))


def test_portfolio_performance_does_not_repeat_holdings_for_its_distinct_counts(spark):
    assert "Expand" not in plan(QUERIES["gold_portfolio_performance_grain_safe"](spark, SMALL))
