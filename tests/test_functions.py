from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans.reference import cusip_check, isin_check
from ledgerloom.functions import scalars as s


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], schema)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "k", "expected"), [
    (1.005, 2, Decimal("1.01")), (-1.005, 2, Decimal("-1.01")), (2.5, 0, Decimal("3")), (0.125, 2, Decimal("0.13")),
    (None, 2, None)])
def test_round_to_is_half_away_from_zero(spark, value, k, expected):
    assert one(spark, s.round_to("v", k), v=("double", value)) == expected


@pytest.mark.parametrize(("a", "b", "expected"), [(1.0, 4.0, 0.25), (1.0, 0.0, None), (None, 2.0, None), (0.0, 3.0, 0.0)])
def test_safe_div(spark, a, b, expected):
    assert one(spark, s.safe_div("a", "b"), a=("double", a), b=("double", b)) == expected


@pytest.mark.parametrize(("ssn", "expected"), [
    ("123-45-6789", "XXX-XX-6789"), ("123456789", "XXX-XX-6789"), ("12-34-5678", None), ("", None), (None, None)])
def test_mask_ssn(spark, ssn, expected):
    assert one(spark, s.mask_ssn("v"), v=("string", ssn)) == expected


@pytest.mark.parametrize(("text", "expected"), [
    ("2001-02-28", date(2001, 2, 28)), ("2001-02-30", None), ("soon", None), (None, None)])
def test_parse_day_never_fails(spark, text, expected):
    assert one(spark, s.parse_day("v"), v=("string", text)) == expected


def test_hours_are_whole_hours_elapsed(spark):
    a, b = datetime(2024, 1, 1, 0, 59), datetime(2024, 1, 1, 1, 1)
    cols = {"a": ("timestamp_ntz", a), "b": ("timestamp_ntz", b)}
    assert one(spark, s.hours_between("a", "b"), **cols) == 0
    assert one(spark, s.hours_between("b", "a"), **cols) == 0


def test_quarter_end(spark):
    assert one(spark, s.quarter_end("v"), v=("date", date(2000, 2, 29))) == date(2000, 3, 31)
    assert one(spark, s.quarter_end("v"), v=("date", date(2000, 12, 31))) == date(2000, 12, 31)


def test_bands_take_the_first_bound_reached(spark):
    steps = ((800, "high"), (670, "mid"))
    assert [one(spark, s.bands("v", steps, "low"), v=("int", v)) for v in (850, 800, 799, 669)] == [
        "high", "high", "mid", "low"]


def test_mean_does_not_depend_on_row_order(spark):
    rows = [(Decimal("0.10"),), (Decimal("0.20"),), (Decimal("-0.05"),), (None,)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "v decimal(18,2)")
        assert df.agg(s.mean("v", 4).alias("x")).first().x == Decimal("0.0833")


def test_publish_turns_decimals_into_doubles(spark):
    df = spark.createDataFrame([(Decimal("1.25"), 3)], "a decimal(18,2), b bigint")
    assert s.publish(df).dtypes == [("a", "double"), ("b", "bigint")]
    assert s.publish(df.select(F.col("b"))).dtypes == [("b", "bigint")]


def test_check_digits_of_security_numbers(spark):
    rows = [("037833100", "US0378331005"), ("037833101", "US0378331004"), ("38259P508", "US38259P5089"), ("12345", "123"), (None, None)]
    df = spark.createDataFrame(rows, "cusip string, isin string")
    got = df.select(cusip_check(F.col("cusip")).alias("c"), isin_check(F.col("isin")).alias("i")).collect()
    assert [(r.c, r.i) for r in got] == [(True, True), (False, False), (True, True), (None, None), (None, None)]
