"""Experiment kinds: schema + fit, with an extension point.

A kind is a name, its typed columns and either

* a density: 1 to 3 parameters, a function to sufficient statistics (one row per
  group) and the log density as a Column of the parameters and those statistics; the posterior
  is then found by ``operators.adaptive``, with no further code; or
* a fit function DataFrame -> posterior DataFrame of its own.

Registering a kind also makes ingest validation and the table registry accept it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bayes_ops.operators import adaptive
from bayes_ops.operators.adaptive import LogDensity, Parameter
from bayes_ops.sources.schemas import KIND_COLUMNS, SUPPORTED_KINDS

Fit = Callable[..., DataFrame]
_FITS: dict[str, Fit] = {}
_DENSITIES: dict[str, tuple] = {}


def register_kind(name: str, columns: list[tuple[str, T.DataType]], fit: Fit) -> None:
    """Add (or replace) an experiment kind."""
    KIND_COLUMNS[name] = list(columns)
    if name not in SUPPORTED_KINDS:
        SUPPORTED_KINDS.append(name)
    _FITS[name] = fit


def register_density(name: str, columns: list[tuple[str, T.DataType]], parameters: Sequence[Parameter],
                     suffstats: Callable[..., DataFrame], logp: LogDensity) -> None:
    """Add (or replace) a kind given by its log density.

    ``suffstats(df, group_by)``: one row per group (a list of columns, may be empty) with the statistics.
    ``logp({parameter: Column})``: log posterior density up to a constant, priors included; statistics
    are ``F.col`` of their names.  ``posterior(name, df, group_by=[..])`` gives one row per group and parameter:
    mean, sd, median, hdi_3, hdi_97."""
    def fit(df: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
        return adaptive.summaries(suffstats(df, list(group_by)), list(group_by), parameters, logp)

    register_kind(name, columns, fit)
    _DENSITIES[name] = (list(parameters), suffstats, logp)


def density_curves(kind: str, df: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Marginal density curves of a kind given by its log density: (group_by, param, i, x, y)."""
    parameters, suffstats, logp = _DENSITIES[kind]
    return adaptive.curves(suffstats(df, list(group_by)), list(group_by), parameters, logp)


def kinds() -> list[str]:
    return list(_FITS)


def posterior(kind: str, df: DataFrame, **params) -> DataFrame:
    """Posterior summary of an experiment table of the given kind."""
    if kind not in _FITS:
        raise KeyError(f"Unknown experiment type '{kind}'")
    return _FITS[kind](df, **params)


def _builtin() -> None:
    from bayes_ops.plans.ab import ab_posterior
    from bayes_ops.plans.bandit import bandit_with_prob_best
    from bayes_ops.plans.bernoulli import bernoulli_posterior
    from bayes_ops.plans.hazard import hazard_posterior
    from bayes_ops.plans.poisson import poisson_posterior
    from bayes_ops.plans.weibull import weibull_posterior
    fits = {
        "poisson-cohorts": lambda df, start, end, **kw: poisson_posterior(df, start, end, **kw),
        "ab-test": lambda df, **kw: ab_posterior(df, **kw),
        "bernoulli": lambda df, **kw: bernoulli_posterior(df, **kw),
        "multi-armed-bandits": lambda df, **kw: bandit_with_prob_best(df, **kw),
        "weibull": lambda df, **kw: weibull_posterior(df, **kw),
        "hazard-rate": lambda df, **kw: hazard_posterior(df, **kw),
    }
    for name, fit in fits.items():
        _FITS[name] = fit
    from bayes_ops.plans.hier_poisson import hier_poisson_posterior
    register_kind("poisson-pooled", KIND_COLUMNS["poisson-cohorts"],
                  lambda df, start, end, **kw: hier_poisson_posterior(df, start, end, **kw))


_builtin()
