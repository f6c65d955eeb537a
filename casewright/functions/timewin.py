"""Windows of time relative to an as-of moment; nothing here asks the clock.

Bounds are computed in Python and enter plans as literals of the column's own type, so they are pushed down to the scan. A
date counts as its midnight: the day of a lower bound that isn't midnight is out.
"""

from __future__ import annotations

import calendar
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: date | datetime | str) -> datetime:
    """As-of as a datetime without zone; a date is its midnight."""
    if isinstance(as_of, str):
        return datetime.fromisoformat(as_of)
    return as_of if isinstance(as_of, datetime) else datetime(as_of.year, as_of.month, as_of.day)


def months_before(at: datetime, n: int) -> datetime:
    """The same day of the month n months before, or that month's last."""
    months = 12 * at.year + at.month - 1 - n
    year, month = divmod(months, 12)
    return at.replace(year=year, month=month + 1, day=min(at.day, calendar.monthrange(year, month + 1)[1]))


def month_start(at: datetime, back: int = 0) -> datetime:
    """Midnight of the first day of the month ``back`` months before."""
    return months_before(datetime(at.year, at.month, 1), back)


def year_start(at: datetime) -> datetime:
    return datetime(at.year, 1, 1)


def first_day(bound: datetime) -> date:
    """The first day whose midnight is at or after the bound."""
    midnight = datetime(bound.year, bound.month, bound.day)
    return (midnight if bound == midnight else midnight + timedelta(days=1)).date()


def day(bound: datetime) -> Column:
    return F.lit(first_day(bound))


def instant(bound: datetime) -> Column:
    return F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz")


def since(dates: Column | str, bound: datetime) -> Column:
    """The date column is at or after the bound."""
    return (F.col(dates) if isinstance(dates, str) else dates) >= day(bound)


def within(dates: Column | str, low: datetime, high: datetime) -> Column:
    """The date column is at or after ``low`` and before ``high``."""
    c = F.col(dates) if isinstance(dates, str) else dates
    return (c >= day(low)) & (c < day(high))
