"""Values as text for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from costwright.functions.money import col, exact_round, plain

# Unit names in ascending order, each 1024 times the one before.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")


def fmt_usd(amount, decimals: int = 2) -> Column:
    text = F.concat(F.lit("$"), F.format_number(exact_round(amount, decimals), decimals))
    return F.coalesce(text, F.lit("$0.00"))


def fmt_pct(share, decimals: int = 1) -> Column:
    """A share of one as a percentage; NULL reads N/A."""
    return F.coalesce(F.concat(plain(col(share) * 100, decimals), F.lit("%")), F.lit("N/A"))


def fmt_pct_change(old, new, decimals: int = 1) -> Column:
    old, new = col(old), col(new)
    change = (new - old) / F.abs(F.nullif(old, F.lit(0)))
    sign = F.when(change >= 0, "+").otherwise("")
    return F.coalesce(F.concat(sign, plain(change * 100, decimals), F.lit("%")), F.lit("N/A"))


def fmt_dbu(amount, decimals: int = 1) -> Column:
    amount = col(amount)
    text = F.when(
        amount >= 1000, F.concat(plain(amount / 1000, decimals), F.lit("K DBU"))
    ).otherwise(F.concat(plain(amount, decimals), F.lit(" DBU")))
    return F.coalesce(text, F.lit("0"))


def fmt_bytes(size) -> Column:
    size = col(size).cast("double")
    text = F.when(size.isNull(), "0 B")
    for power, unit in enumerate(BYTE_UNITS):
        scaled = F.concat(plain(size / float(1024**power)), F.lit(f" {unit}"))
        if unit == BYTE_UNITS[-1]:
            return text.otherwise(scaled)
        text = text.when(F.abs(size) < float(1024 ** (power + 1)), scaled)


def fmt_duration(seconds) -> Column:
    """Days, hours, minutes and seconds; seconds are left out beside days."""
    whole = col(seconds).cast("long")
    days = F.floor(whole / 86400)
    rest = F.pmod(whole, F.lit(86400))

    def part(value, unit, shown):
        return F.when(shown, F.concat(value.cast("string"), F.lit(unit)))

    hours = F.floor(rest / 3600)
    minutes = F.floor(F.pmod(rest, F.lit(3600)) / 60)
    secs = F.pmod(rest, F.lit(60))
    text = F.concat_ws(
        " ",
        part(days, "d", days != 0),
        part(hours, "h", hours != 0),
        part(minutes, "m", minutes != 0),
        part(secs, "s", (secs != 0) & (days == 0)),
    )
    return F.when(text == "", "0s").otherwise(text)


def truncate(text, max_len: int = 100, suffix: str = "...") -> Column:
    text = col(text)
    cut = F.concat(F.substring(text, 1, max_len - len(suffix)), F.lit(suffix))
    return F.when(F.length(text) > max_len, cut).otherwise(text)


def table_row(*cells: Column) -> Column:
    """One markdown table row; a pipe inside a cell is escaped."""
    texts = [F.replace(cell, F.lit("|"), F.lit("\\|")) for cell in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *texts), F.lit(" |"))
