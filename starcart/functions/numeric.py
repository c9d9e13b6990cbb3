"""Money and ratio helpers.

Money stays exact: sums are decimals, and ratios of money (AOV, margin %,
shares, means) are exact decimal divisions rounded half away from zero, as the
warehouse's DECIMAL arithmetic does. A half cent such as 2330250.15 / 10 must
round up to .02; a double division would land just below and round down.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_SUM = "decimal(20,2)"


def money_sum(col: str | Column) -> Column:
    """Exact sum of a decimal(10,2) column, typed decimal(20,2)."""
    return F.sum(col).cast(MONEY_SUM)


def round_dec(x: Column, digits: int = 2, precision: int = 20) -> Column:
    """Round a decimal (or a double through decimal(38,12)) half away from zero."""
    return F.round(x.cast("decimal(38,12)"), digits).cast(f"decimal({precision},{digits})")


def div_round(
    num: Column,
    den: Column,
    digits: int = 2,
    times: int = 1,
    zero: str = "null",
    floor: float | None = None,
) -> Column:
    """round(num / den * times, digits), exact, half away from zero.

    ``num``/``den`` are money decimals or integer counts. The numerator is
    scaled first and kept at decimal(24,2), so the quotient carries 14 decimal
    digits before the final rounding.

    zero="null": NULL when den = 0 (declared SQL semantics, NULLIF).
    zero="floor": den replaced by greatest(den, floor) (the embedded copy's guard).
    """
    n = (num.cast("decimal(22,2)") * F.lit(times)).cast("decimal(24,2)")
    d = den.cast("decimal(20,2)")
    if zero == "floor":
        if floor is None:
            raise ValueError("zero='floor' needs a floor value")
        d = F.greatest(d, F.lit(str(floor)).cast("decimal(20,2)"))
    q = F.when(d == 0, F.lit(None)).otherwise(n / d)
    return F.round(q, digits).cast(f"decimal(20,{digits})")


def money_mean(col: str | Column, digits: int = 2) -> Column:
    """Exact mean of a decimal or integer column, rounded."""
    c = F.col(col) if isinstance(col, str) else col
    return div_round(F.sum(c), F.count(c), digits)


def padded(key: Column, width: int) -> Column:
    """A key as text, filled with zeros to ``width``; longer keys stay whole (``lpad`` would cut them)."""
    text = key.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
