"""Windows of calendar days ending at an explicit date."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_days(as_of: date, days: int, column: str = "usage_date") -> Column:
    """True from `as_of - days` to `as_of`, both included: `days + 1` dates.

    The bounds are literals, so the test reaches the file scan.
    """
    return F.col(column).between(F.lit(as_of - timedelta(days=days)), F.lit(as_of))


def month_to_date(as_of: date, column: str = "usage_date") -> Column:
    return F.col(column).between(F.lit(as_of.replace(day=1)), F.lit(as_of))


def days_ago(as_of: date, n: int) -> Column:
    return F.date_sub(F.lit(as_of), n)
