"""Scalar Column expressions (ops E1-E13): all JVM-side, codegen friendly."""

from bayes_ops.functions.special import lgamma, log_beta_fn  # noqa: F401
from bayes_ops.functions.densities import (  # noqa: F401
    log_beta_kernel, log_gamma_kernel, log_half_cauchy, log_half_normal,
    weibull_pdf, weibull_log_sf, epanechnikov, gaussian_kernel,
)
