"""Date arithmetic with the exact semantics the order tables need.

Two day-difference flavours exist: *floor days* (whole days, rounding toward
minus infinity, so 00:00 minus 06:00 is -1) and *fractional days*. Spark's
``datediff`` is neither for timestamps, so both are built from epoch micros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
EPS = 1e-6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_micros(x) -> Column:
    """Micros since epoch of a date or timestamp column (session TZ = UTC)."""
    return F.unix_micros(_c(x).cast("timestamp"))


def epoch_day(x) -> Column:
    """Whole days since 1970-01-01 of a date/timestamp (floor)."""
    return F.floor(epoch_micros(x) / F.lit(MICROS_PER_DAY)).cast("long")


def floor_days(start, end) -> Column:
    """Whole days from ``start`` to ``end``, floored (null if either is null)."""
    return F.floor((epoch_micros(end) - epoch_micros(start)) / F.lit(MICROS_PER_DAY)).cast("long")


def fractional_days(start, end) -> Column:
    """Fractional days from ``start`` to ``end`` as double."""
    return ((epoch_micros(end) - epoch_micros(start)) / F.lit(float(MICROS_PER_DAY))).cast("double")


def weekday_mon0(x) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(x))


def safe_div(num, den) -> Column:
    """Division that yields null instead of failing or producing infinity."""
    return F.try_divide(_c(num), _c(den))


def eps_div(num, den, eps: float = EPS) -> Column:
    """``num / (den + eps)`` as used for all ratio features; null on exact zero."""
    return F.try_divide(_c(num), _c(den) + F.lit(eps))


def round_decimal(x, digits: int) -> Column:
    """Round half-up on the value first rounded to 12 decimals, so sums that
    differ only by summation order (e.g. 9.533749999999999 vs 9.53375) round
    the same way."""
    return F.round(_c(x).cast("decimal(38,12)"), digits).cast("double")
