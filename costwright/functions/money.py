"""Exact money arithmetic.

Costs stay DECIMAL from the record up, so sums do not depend on the order of
addition. A value is turned into DOUBLE only at the edge of an operator, and it
is rounded as a DECIMAL first: half up, and the same on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(28,8)"


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def exact_round(value, places: int) -> Column:
    """`value` rounded half up to `places`, still DECIMAL."""
    return F.round(col(value).cast(EXACT), places)


def rounded(value, places: int = 2) -> Column:
    """`value` rounded half up to `places`, as DOUBLE."""
    return exact_round(value, places).cast("double")


def mean_of(total, count) -> Column:
    """`total / count` as DOUBLE; NULL when there is nothing to average."""
    return col(total).cast("double") / F.nullif(col(count), F.lit(0))


def plain(value, places: int = 2) -> Column:
    """Text with exactly `places` decimals and no thousands separator."""
    return exact_round(value, places).cast(f"decimal(28,{places})").cast("string")


def shortest(value) -> Column:
    """Text of a two-decimal amount with one trailing zero dropped: 12.5, 12.0."""
    return F.regexp_replace(plain(value, 2), "0$", "")
