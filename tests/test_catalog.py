"""Every registered query against its SQL twin on the same parquet files."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from ledgerloom import oracle_catalog, query_catalog
from tests.conftest import SMALL
from tests.support import difference

QUERIES = query_catalog()
ORACLE = oracle_catalog()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def test_flagship_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_twin(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in got.collect()]
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert difference(got.columns, rows, columns, cursor.fetchall()) == ""
