"""Column expressions shared by the operators (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """lower(trim(x)): the staging normalisation of categorical text."""
    return F.lower(F.trim(col_(c)))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Null-safe ratio as a double: NULL when the divisor is 0 or NULL.

    Both sides are cast to double first, so decimal money and integer counts
    give the same type (and the same bits) as a plain float division.
    """
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double"))


def pct(a: str | Column, b: str | Column, digits: int = 2) -> Column:
    """round(a / b * 100, digits), NULL on a zero divisor."""
    return F.round(safe_div(a, b) * F.lit(100.0), digits)


def share_pct(a: str | Column, b: str | Column, digits: int) -> Column:
    """round(a * 100.0 / b, digits) in double arithmetic (multiply first)."""
    return F.round(F.try_divide(col_(a).cast("double") * F.lit(100.0), col_(b).cast("double")), digits)


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed minutes from start to end (truncated, signed)."""
    return F.timestamp_diff("MINUTE", col_(start), col_(end))


def hours_between(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed hours from start to end (truncated, signed)."""
    return F.timestamp_diff("HOUR", col_(start), col_(end))


def days_between(start: str | Column, end: str | Column) -> Column:
    """Signed calendar-day difference of the dates of two instants."""
    return F.datediff(F.to_date(col_(end)), F.to_date(col_(start)))


def week_start(d: str | Column) -> Column:
    """Monday of the week of a date (DATE)."""
    return F.trunc(col_(d), "week")


def month_start(d: str | Column) -> Column:
    return F.trunc(col_(d), "month")


def ntz(text: str) -> Column:
    """A TIMESTAMP_NTZ literal (the parquet timestamps load without zone)."""
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def add_hours(ts: str | Column, hours: str | Column) -> Column:
    return F.timestamp_add("HOUR", col_(hours), col_(ts))
