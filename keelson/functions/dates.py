"""Date parsing and calendar keys.

Every function returns a Column built from built-in expressions; there is no
Python UDF on the row path.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column | str) -> Column:
    """Parse ``yyyy-M-d`` text into a DATE; months and days may have one digit.

    Malformed text gives NULL instead of an error, and what follows the date
    after a space or a ``T`` is ignored: ``2024-1-5 10:00`` is 2024-01-05.
    Already-typed DATE / TIMESTAMP columns are cast directly by callers.
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.try_to_date(F.split(F.trim(col.cast("string")), "[ T]")[0], "yyyy-M-d")


def to_date_any(c: Column | str) -> Column:
    """DATE from a DATE, TIMESTAMP(_NTZ) or text column."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("date")


def lit_date(d) -> Column:
    """A DATE literal from ``date``/``datetime``/``'yyyy-MM-dd'`` text."""
    return F.lit(as_date(d))


def as_date(d) -> _dt.date:
    """A date from ``date``/``datetime``/``'yyyy-M-d'`` text; an error for anything else."""
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    if not isinstance(d, str):
        raise ValueError(f"not a date: {d!r}")
    year, month, day = d.strip().split("-")
    return _dt.date(int(year), int(month), int(day))


def month_key(d: Column) -> Column:
    """First day of the month as text, ``yyyy-MM-01``."""
    return F.date_format(d, "yyyy-MM-01")


def month_period(d: Column) -> Column:
    """Calendar month as text, ``yyyy-MM`` (a pandas monthly period)."""
    return F.date_format(d, "yyyy-MM")


def yearweek(d: Column) -> Column:
    """MySQL ``YEARWEEK(d)`` in its default mode 0.

    Weeks start on Sunday and week 1 is the one holding the year's first
    Sunday; days before it belong to the last week of the previous year.
    With ``s`` the Sunday on or before ``d`` this is
    ``year(s) * 100 + (dayofyear(s) - 1) div 7 + 1``.
    """
    s = F.date_sub(d, F.dayofweek(d) - 1)
    return F.year(s) * 100 + F.floor((F.dayofyear(s) - 1) / 7).cast("int") + 1


def monday_week(d: Column) -> Column:
    """Monday-to-Sunday week label ``yyyy-MM-dd/yyyy-MM-dd`` (pandas ``W``)."""
    start = F.date_trunc("week", d).cast("date")
    return F.concat_ws("/", F.date_format(start, "yyyy-MM-dd"),
                       F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))


def month_diff(start: Column, end: Column) -> Column:
    """Completed calendar months from ``start`` to ``end``, truncated toward 0.

    Matches MySQL ``TIMESTAMPDIFF(MONTH, start, end)``: 01-31 to 02-29 is 0.
    ``months_between`` rounds month ends differently and is not used.
    """
    return F.timestamp_diff("MONTH", start.cast("timestamp_ntz"), end.cast("timestamp_ntz")).cast("int")
