"""Shares and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, total: Column) -> Column:
    """part / total, 0 when there is nothing."""
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def _fixed_point(value: Column, digits: int) -> Column:
    """Decimal text of the exact binary value, rounded half to even.

    ``round`` and ``format_string`` work on the shortest decimal form instead
    and turn 3/20000 into 0.0002.  Number formatting keeps the binary value,
    but loses the one value that sits half way below the last digit.
    """
    half = 5 / 10 ** (digits + 1)
    return F.when(value == half, F.lit(f"{half:.{digits}f}")).otherwise(
        F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
    )


def rounded(value: Column, digits: int = 4) -> Column:
    return _fixed_point(value, digits).cast("double")


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(_fixed_point(value * 100, digits), F.lit("%"))


def floor_percent(part: Column, total: Column) -> Column:
    """Whole percent, cut: 19.6 % is 19."""
    return F.floor(share(part, total) * 100)


def floor_share(part: Column, total: Column) -> Column:
    """Share cut to two decimals."""
    return F.floor(share(part, total) * 100) / 100


def loc_needed(loc: Column, part: Column, minimum: float) -> Column:
    """Lines still to add until ``part`` reaches the share ``minimum``; adding
    them grows the total too."""
    gap = (F.lit(minimum) * loc - part) / F.lit(1 - minimum)
    return F.greatest(F.lit(1), F.ceil(gap)).cast("bigint")
