"""Log densities, the Weibull pdf/survival and smoothing kernels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _xlog(coef: Column, arg_log: Column) -> Column:
    """coef * log-term, defined as 0 when coef == 0 (avoids 0 * -inf)."""
    return F.when(coef == 0, F.lit(0.0)).otherwise(coef * arg_log)


def log_gamma_kernel(x: Column, a: Column, b: Column, c: Column) -> Column:
    """Unnormalised log Gamma(a, rate b) density, centred at c > 0.

    (a-1) log(x/c) - b (x - c): the centring keeps the terms small for huge
    shape values, so the subtraction of the group maximum stays exact.
    """
    return _xlog(a - 1, F.log1p((x - c) / c)) - b * (x - c)


def log_beta_kernel(x: Column, a: Column, b: Column, c: Column) -> Column:
    """Unnormalised log Beta(a, b) density centred at c in (0, 1)."""
    return (_xlog(a - 1, F.log1p((x - c) / c))
            + _xlog(b - 1, F.log1p((c - x) / (F.lit(1.0) - c))))


def log_half_cauchy(x: Column, scale: float) -> Column:
    """log HalfCauchy(x; scale) up to its constant."""
    return -F.log1p((x / F.lit(scale)) * (x / F.lit(scale)))


def log_half_normal(x: Column, sigma: float) -> Column:
    """log HalfNormal(x; sigma) up to its constant."""
    return -(x * x) / F.lit(2.0 * sigma * sigma)


def weibull_pdf(x: Column, alpha: Column, beta: Column) -> Column:
    """alpha/beta (x/beta)^(alpha-1) exp(-(x/beta)^alpha); 0 outside the support."""
    z = x / beta
    val = alpha / beta * F.pow(z, alpha - 1) * F.exp(-F.pow(z, alpha))
    return F.when((x < 0) | (alpha <= 0) | (beta <= 0), F.lit(0.0)).otherwise(val)


def weibull_log_sf(t: Column, alpha: Column, beta: Column) -> Column:
    """log S(t) = -(t/beta)^alpha."""
    return -F.pow(t / beta, alpha)


def epanechnikov(u: Column, h: Column) -> Column:
    """0.75 (1 - u^2) / h on |u| <= 1, else 0; u = (x - sample) / h."""
    return F.when(F.abs(u) <= 1, F.lit(0.75) * (F.lit(1.0) - u * u) / h).otherwise(F.lit(0.0))


def gaussian_kernel(u: Column, h: Column) -> Column:
    """exp(-u^2/2) / (sqrt(2 pi) h); u = (x - sample) / h."""
    return F.exp(-(u * u) / 2) / (F.lit(math.sqrt(2 * math.pi)) * h)
