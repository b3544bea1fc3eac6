"""Log-gamma and log-beta as Column expressions (op E6).

Spark SQL has no lgamma.  We shift the argument up by 8 with the recurrence
Gamma(x+1) = x Gamma(x) and use the Stirling series at z = x + 8 >= 8, where
its truncation error is below 1e-11 for every x > 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
_SHIFT = 8


def lgamma(x: Column) -> Column:
    z = x + F.lit(float(_SHIFT))
    iz = F.lit(1.0) / z
    iz2 = iz * iz
    series = iz * (F.lit(1.0 / 12.0) - iz2 * (F.lit(1.0 / 360.0) - iz2 * (
        F.lit(1.0 / 1260.0) - iz2 * F.lit(1.0 / 1680.0))))
    stirling = (z - F.lit(0.5)) * F.log(z) - z + F.lit(_HALF_LOG_2PI) + series
    shift = F.log(x)
    for k in range(1, _SHIFT):
        shift = shift + F.log(x + F.lit(float(k)))
    return stirling - shift


def log_beta_fn(a: Column, b: Column) -> Column:
    """log B(a, b) = lgamma(a) + lgamma(b) - lgamma(a + b)."""
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def lgamma_ratio(a: Column, s: Column) -> Column:
    """log Gamma(a + s) - log Gamma(a) for s >= 0.

    For large ``a`` the two terms nearly cancel, so the Stirling forms are
    subtracted term by term; the error stays relative to s log(a + s).
    """
    def tail(z: Column) -> Column:
        return F.lit(1.0 / 12.0) / z - F.lit(1.0 / 360.0) / (z * z * z)
    far = ((a - F.lit(0.5)) * F.log1p(s / a) + s * F.log(a + s) - s + tail(a + s) - tail(a))
    return F.when(a < 100, lgamma(a + s) - lgamma(a)).otherwise(far)
