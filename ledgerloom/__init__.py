"""ledgerloom: a bank lakehouse (bronze, silver, gold, quality, governance) as Spark DataFrame code."""

from __future__ import annotations


def query_catalog():
    """Every registered query by name."""
    from ledgerloom.catalog import QUERIES

    return dict(QUERIES)


def oracle_catalog():
    """The SQL twin of every query that SQL can express."""
    from ledgerloom.oracle import ORACLE

    return dict(ORACLE)
