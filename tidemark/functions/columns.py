"""Column helpers: times as microseconds, and statistics whose definitions the whole library shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone; the session's time zone plays no part."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(c))


def day_of(us: Column) -> Column:
    """Number of the day since 1970."""
    return F.floor(us / DAY)


def time_of_day(us: Column) -> Column:
    return F.pmod(us, F.lit(DAY))


def hour_of(us: Column) -> Column:
    return F.floor(time_of_day(us) / HOUR)


def skew_population(c: str | Column) -> Column:
    """Biased skewness g1; null for a single value or without spread."""
    return F.skewness(c)


def skew_sample(c: str | Column) -> Column:
    """Bias-corrected skewness G1; null for fewer than 3 values."""
    n = F.count(c)
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_population(c: str | Column) -> Column:
    """Biased excess kurtosis g2."""
    return F.kurtosis(c)


def kurtosis_sample(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis G2; null for fewer than 4 values."""
    n = F.count(c).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def quantile(c: str | Column, q: float) -> Column:
    """Linearly interpolated quantile."""
    return F.percentile(c, F.lit(q))


def iqr(c: str | Column) -> Column:
    return quantile(c, 0.75) - quantile(c, 0.25)


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's correlation; null where either side has no spread."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.covar_pop(x, y) / F.when(spread > 0, spread))
