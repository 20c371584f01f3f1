"""Rule templates: each returns the rows that break a rule.

The two NULL readings are kept apart: a format or ordering check fails a NULL,
a range check lets it pass.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import day_lit, is_true
from ledgerloom.quality.rules import FICO, MAX_RATE


def breaks_format(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(~is_true(F.col(column).rlike(pattern)))


def negative(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) < 0)


def rate_out_of_range(df: DataFrame, column: str) -> DataFrame:
    return df.where((F.col(column) < 0) | (F.col(column) > MAX_RATE))


def fico_out_of_range(df: DataFrame, column: str) -> DataFrame:
    score = F.col(column).cast("bigint")
    return df.where((score < FICO[0]) | (score > FICO[1]))


def in_future(df: DataFrame, column: str, today: date) -> DataFrame:
    return df.where(F.col(column) > day_lit(today))


def out_of_order(df: DataFrame, column: str, end_column: str) -> DataFrame:
    return df.where(~is_true(F.col(column) <= F.col(end_column)))


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose value is missing from the parent; NULL values are orphans too."""
    keys = parent.select(F.col(parent_column).alias("_parent")).distinct()
    return df.join(keys, F.col(column) == F.col("_parent"), "left_anti")


def violations(df: DataFrame, broken: Column) -> DataFrame:
    return df.where(is_true(broken))
