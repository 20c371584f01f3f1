"""Scalar building blocks shared by every plan. All of them are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SSN_DASHED = r"^\d{3}-\d{2}-\d{4}$"
SSN_PLAIN = r"^\d{9}$"
MASK = "XXX-XX-"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec(c: Column | str, scale: int = 2, width: int = 18) -> Column:
    return _col(c).cast(T.DecimalType(width, scale))


def dbl(c: Column | str) -> Column:
    return _col(c).cast("double")


def abs_round(c: Column | str, k: int) -> Column:
    """|c| rounded half away from zero to k decimals, kept exact."""
    return dec(F.round(F.abs(_col(c)), k), k)


def round_to(c: Column | str, k: int) -> Column:
    """Round a double half away from zero.

    Going through a decimal with four spare digits makes 1.005 round like the
    number that was written, not like its binary neighbour.
    """
    return F.round(_col(c).cast(T.DecimalType(38, k + 4)), k)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b as double; NULL when b is zero or either side is NULL."""
    return F.try_divide(dbl(a), dbl(b))


def ratio(a: Column | str, b: Column | str, k: int) -> Column:
    return round_to(safe_div(a, b), k)


def percent(part: Column | str, whole: Column | str, k: int = 2) -> Column:
    return round_to(safe_div(part, whole) * 100, k)


def mean(c: Column | str, k: int) -> Column:
    """Average whose sum is exact (decimal or integer), so row order cannot change it."""
    c = _col(c)
    return ratio(F.sum(c), F.count(c), k)


def total(c: Column | str, k: int = 2) -> Column:
    return F.round(F.sum(_col(c)), k)


def or_zero(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def month_of(c: Column | str) -> Column:
    return F.trunc(_col(c).cast("date"), "MM")


def quarter_of(c: Column | str) -> Column:
    return F.trunc(_col(c).cast("date"), "quarter")


def quarter_end(c: Column | str) -> Column:
    return F.last_day(F.add_months(quarter_of(c), 2))


def micros(c: Column | str) -> Column:
    """Microseconds of a zone-free time since 1970.

    Built from the date and time fields: arithmetic on zone-free times passes
    through the session time zone and would move the hour of a clock change.
    """
    t = _col(c)
    seconds = F.unix_date(t.cast("date")).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    fraction = F.extract(F.lit("SECOND"), t) * F.lit(1_000_000)
    return seconds * F.lit(1_000_000).cast("bigint") + fraction.cast("bigint")


def elapsed(start: Column | str, end: Column | str, unit_seconds: int) -> Column:
    """Whole units between two zone-free times, truncated toward zero."""
    unit = F.lit(unit_seconds * 1_000_000).cast("bigint")
    gap = micros(end) - micros(start)
    return ((gap - gap % unit) / unit).cast("bigint")


def hours_between(start: Column | str, end: Column | str) -> Column:
    return elapsed(start, end, 3600)


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return elapsed(start, end, 60)


def parse_day(c: Column | str) -> Column:
    """Date from text, NULL where the text is no date."""
    return F.try_to_date(_col(c), "yyyy-MM-dd")


def mask_ssn(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.rlike(SSN_DASHED), F.concat(F.lit(MASK), F.substring(c, 8, 4))).when(
        c.rlike(SSN_PLAIN), F.concat(F.lit(MASK), F.substring(c, 6, 4))
    )


def mask_tail(c: Column | str) -> Column:
    """Mask an undashed nine-digit id down to its last four digits."""
    return F.concat(F.lit(MASK), F.substring(_col(c), 6, 4))


def bands(c: Column | str, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first lower bound that c reaches; bounds are given high to low."""
    c = _col(c)
    out = F.when(c >= steps[0][0], steps[0][1])
    for low, label in steps[1:]:
        out = out.when(c >= low, label)
    return out.otherwise(otherwise)


def is_true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def day_lit(d: date) -> Column:
    return F.lit(d).cast("date")


def ts_lit(t: datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def publish(df: DataFrame) -> DataFrame:
    """Output edge: exact decimals become doubles, everything else stays."""
    if not any(isinstance(f.dataType, T.DecimalType) for f in df.schema):
        return df
    return df.select(
        [F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
         for f in df.schema]
    )
