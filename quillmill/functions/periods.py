"""Period filters as predicates that the scan can push down."""

from __future__ import annotations

import calendar
import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def closed_month(ts: Column, year: int, month: int) -> Column:
    """From the first instant of the month to 23:59:59 of its last day, without that second's fractions."""
    last = calendar.monthrange(year, month)[1]
    return (ts >= F.lit(datetime(year, month, 1))) & (ts <= F.lit(datetime(year, month, last, 23, 59, 59)))


def parse_month(value: str) -> tuple[datetime, datetime] | None:
    """Start and end (exclusive) of a month given as YYYY.MM, YYYY/MM or YYYY-MM; None if it is no month."""
    found = re.fullmatch(r"\s*(\d{4})[./-](\d{1,2})\s*", value or "")
    if not found or not 1 <= int(found[2]) <= 12:
        return None
    year, month = int(found[1]), int(found[2])
    return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)


def half_open_month(ts: Column, value: str) -> Column:
    bounds = parse_month(value)
    if bounds is None:
        raise ValueError(f"not a month: {value}")
    return (ts >= F.lit(bounds[0])) & (ts < F.lit(bounds[1]))


def period(start: date | None, end: date | None, today: date) -> tuple[datetime, datetime]:
    """Closed days as a half-open range of instants; the last 30 days if nothing is given."""
    end = end or today
    start = start or end - timedelta(days=30)
    if start > end:
        raise ValueError("the period ends before it begins")
    return datetime(start.year, start.month, start.day), datetime(end.year, end.month, end.day) + timedelta(days=1)
