"""Small numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Borders of the waiting-time classes, in hours.
CLASS_HOURS = (24.0, 168.0, 720.0)


def log10_hours(hours: Column) -> Column:
    return F.log10(F.lit(1.0) + hours)


def to_label(hours: Column) -> Column:
    return F.log1p(hours)


def from_label(value: Column) -> Column:
    return F.expm1(value)


def wait_class(hours: Column, borders: tuple[float, ...] = CLASS_HOURS) -> Column:
    """How many borders are at or below the value (so exactly 24 hours is class 1)."""
    return F.size(F.filter(F.array(*(F.lit(b) for b in borders)), lambda b: b <= hours))


def layer_quota(n: Column, own: Column, shared: Column) -> Column:
    """The share of n that an own layer gives beside a shared one, rounded half to even."""
    return F.bround(n * own / (own + shared)).cast("long")


def two_sided(z: Column) -> Column:
    """The chance that a standard normal value lies as far from 0 as z, to about 1e-7."""
    # Coefficients of a published rational approximation of the error function.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + F.lit(0.3275911) * x)
    total = F.lit(a[4])
    for k in (3, 2, 1, 0):
        total = total * t + F.lit(a[k])
    return total * t * F.exp(-x * x)


def for_log_axis(value: Column, least: float = 1e-3) -> Column:
    return F.greatest(value, F.lit(least))


def needs_log_axis(low: Column, high: Column, ratio: float = 100.0) -> Column:
    return F.coalesce((low > 0) & (high / low > ratio), F.lit(False))
