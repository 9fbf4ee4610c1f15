"""Column expressions that the operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, with one zero instead of two signed ones."""
    return F.round(x, digits) + F.lit(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    """Bounded; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def no_nan(x: Column) -> Column:
    """NaN as null, since missing values are skipped."""
    return F.when(~F.isnan(x), x)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where either side is constant or missing."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when(~constant, F.try_divide(F.covar_pop(a, b), spread))


def relative_change(new: Column, old: Column) -> Column:
    """Percent by which new differs from old; negative where new is smaller."""
    return 100 * (F.try_divide(new, old) - 1)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))


def spearman_brown(r: Column) -> Column:
    return F.try_divide(2 * r, 1 + r)


def logit(p: Column, floor: float = 1e-6) -> Column:
    q = clip(p, floor, 1 - floor)
    return F.ln(q / (1 - q))


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days as a double, for timestamps with or without zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86_400_000_000.0)


def safe_ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)


def lcg(*parts: Column) -> Column:
    """A portable pseudo-random integer in [0, 2**31 - 1) from integers: the same in any SQL engine.

    Each part is taken in by a linear step and a square modulo a prime; without the square the orders of one
    key's values would be turns of each other.
    """
    prime = F.lit(2147483647).cast("long")
    h = F.lit(17).cast("long")
    for p in parts:
        h = F.pmod(h * 1103515 + F.pmod(p.cast("long"), prime) * 12345 + 1013904, prime)
        h = F.pmod(h * h + 12345, prime)
    return F.pmod(h * 48271, prime)


def lcg_array(*parts) -> np.ndarray:
    """lcg of integers and integer arrays, which are broadcast against each other."""
    prime, h = 2147483647, np.int64(17)
    for p in parts:
        h = (h * np.int64(1103515) + np.asarray(p, np.int64) % prime * 12345 + 1013904) % prime
        h = (h * h + 12345) % prime
    return h * 48271 % prime
