"""Scalar helpers with the null rules of the panel: NaN never survives, division by zero is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(x: str | Column) -> Column:
    """NaN and infinities as null."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ratio(a: str | Column, b: str | Column, eps: float = 0.0) -> Column:
    """a / (b + eps); null where the divisor is 0."""
    d = col(b) + F.lit(eps) if eps else col(b)
    return F.try_divide(col(a).cast("double"), d.cast("double"))


def clip(x: str | Column, low: float, high: float) -> Column:
    """Null stays null."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def flag(condition: Column) -> Column:
    """1.0 or 0.0; a comparison with null counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def normal_cdf(x: str | Column) -> Column:
    """The standard normal distribution function, to 1e-7."""
    z = F.abs(col(x)) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + F.lit(_ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(_ERF):
        poly = (poly + F.lit(a)) * t
    erf = 1.0 - poly * F.exp(-z * z)
    return 0.5 * (1.0 + F.signum(col(x)) * erf)


def turn_of_month(date: str | Column, last: int = 1, first: int = 3) -> Column:
    """Whether a date is one of the ``last`` or ``first`` calendar days of a month."""
    d = col(date)
    return (F.dayofmonth(d) <= first) | (F.datediff(F.last_day(d), d) < last)


def near_quarter_end(date: str | Column, days: int = 5) -> Column:
    """Whether a date lies within so many days of its quarter's end."""
    d = col(date)
    end = F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)
    return F.datediff(end, d) <= days


def lunar_phase(date: str | Column, origin: str = "2000-01-06", period: float = 29.53) -> Column:
    """Days since a new moon modulo the period, as a share of it."""
    return F.pmod(F.datediff(col(date), F.lit(origin).cast("date")).cast("double"), F.lit(period)) / period
