"""Queries against their SQL where keys cut to their width share a time: from 10,000 suppliers or a million parts on."""

from __future__ import annotations

import duckdb
import pytest

from ledgerloom import oracle_catalog
from ledgerloom.catalog import QUERIES
from tests.conftest import SMALL
from tests.support import TABLES, difference

# 12,000 suppliers; parts below, at and above a million, and lines of all of them; customers whose advisor's id is shared
GROWN = {
    "supplier": "SELECT t.* REPLACE (s_suppkey + i * 10 AS s_suppkey) FROM range(1200) r(i), '{file}' t",
    "part": "SELECT t.* REPLACE (p_partkey + i * 1000000 AS p_partkey) FROM range(3) r(i), '{file}' t",
    "lineitem": "SELECT t.* REPLACE (l_partkey + l_orderkey % 3 * 1000000 AS l_partkey, l_suppkey + l_orderkey % 1200 * 10 AS l_suppkey) "
                "FROM '{file}' t",
    "customer": "SELECT t.* REPLACE (c_custkey + 950 AS c_custkey) FROM '{file}' t",
    "orders": "SELECT t.* REPLACE (o_custkey + 950 AS o_custkey) FROM '{file}' t",
}
CUT = (
    "bq_filing_readiness",
    "silver_gl_accounts",
    "silver_securities",
    "gl_hierarchy_rollup",
    "gold_advisor_scorecard_grain_safe",
    "gold_liquidity_coverage",
    "hierarchy_closure_gl",
    "ref_cusip_master",
    "ref_isin_mapping",
)


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    path, con = tmp_path_factory.mktemp("grown"), duckdb.connect()
    for t in TABLES:
        rows = GROWN.get(t, "SELECT * FROM '{file}'").format(file=f"{SMALL}/{t}.parquet")
        con.execute(f"COPY ({rows}) TO '{path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return path, con


@pytest.mark.parametrize("name", CUT)
def test_query_is_that_of_its_sql_where_keys_are_cut(spark, grown, name):
    path, con = grown
    got, want = QUERIES[name](spark, str(path)), con.execute(oracle_catalog()[name])
    rows = [tuple(r) for r in got.collect()]
    assert rows and not difference(got.columns, rows, [d[0] for d in want.description], want.fetchall())
