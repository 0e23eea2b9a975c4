"""Date ranges and date texts on TIMESTAMP_NTZ columns.

All ranges are half-open and compare the bare column with a literal.  The plan
lists them as pushed filters, but Spark's Parquet reader does not skip row
groups by TIMESTAMP_NTZ columns.  Where a table also holds the date of the
column as a DATE column, best as its partition, name it as ``day``: the range
then filters by it too, which prunes partitions and row groups.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def as_datetime(value) -> dt.datetime:
    """Accept ISO text, a date or a datetime."""
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(value)


def ntz(value) -> Column:
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def day_start(value) -> dt.datetime:
    return as_datetime(value).replace(hour=0, minute=0, second=0, microsecond=0)


def month_start(value) -> dt.datetime:
    return day_start(value).replace(day=1)


def next_month(value) -> dt.datetime:
    return month_start(month_start(value) + dt.timedelta(days=32))


def month_end_day(value) -> dt.date:
    return (next_month(value) - dt.timedelta(days=1)).date()


def days_between(day: str | None, first=None, last=None) -> Column:
    """first <= day <= last on a DATE column; open ends and no column add no condition."""
    found = F.lit(True)
    if day and first is not None:
        found = found & (F.col(day) >= F.lit(as_datetime(first).date()))
    if day and last is not None:
        found = found & (F.col(day) <= F.lit(as_datetime(last).date()))
    return found


def in_days(col: Column, first, last, day: str | None = None) -> Column:
    """first <= col < last + 1 day."""
    return (col >= ntz(day_start(first))) & (col < ntz(day_start(last) + dt.timedelta(days=1))) & days_between(day, first, last)


def on_day(col: Column, date, day: str | None = None) -> Column:
    return in_days(col, date, date, day)


def in_month_of(col: Column, as_of, day: str | None = None) -> Column:
    return in_days(col, month_start(as_of), month_end_day(as_of), day)


def in_year(col: Column, year: int, day: str | None = None) -> Column:
    return in_days(col, dt.date(year, 1, 1), dt.date(year, 12, 31), day)


def day_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def dotted_day_text(col: Column) -> Column:
    return F.date_format(col, "yyyy.MM.dd")


def month_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def chart_label(col: Column) -> Column:
    """Month and day without leading zeros, as on the sales chart."""
    return F.date_format(col, "M/d")


def trunc_month(col: Column) -> Column:
    """First day of the month as a DATE, so no zone enters."""
    return F.trunc(col.cast("date"), "month")


def whole_days_between(earlier: Column, as_of) -> Column:
    """Whole elapsed days; null stays null (never happened)."""
    elapsed = F.timestamp_diff("SECOND", earlier, ntz(as_of))
    return F.floor(elapsed / F.lit(86400)).cast("bigint")
