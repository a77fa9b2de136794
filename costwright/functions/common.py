"""Small helpers of all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame


def choose(options: dict, name: str, what: str):
    """The option of that name, or a ValueError that lists them."""
    if name not in options:
        raise ValueError(f"unknown {what} {name!r}; use one of {sorted(options)}")
    return options[name]


def in_order(df: DataFrame, ordered: bool, *by) -> DataFrame:
    """Sorted for a reader; `ordered=False` saves the sort where the rows go on."""
    return df.orderBy(*by) if ordered else df
