"""Poisson cohort rates (ops P4, P10, V3).

k events per group in a half-open window, exposure E = population x window
length in the rate unit (or the summed exposure column), prior
Gamma(a0, b0) (the reference's Exponential(1) = Gamma(1, 1)), posterior
Gamma(a0 + k, b0 + E).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayes_ops.functions.timefmt import unit_seconds
from bayes_ops.operators import filters as flt
from bayes_ops.operators.grid import conjugate_curve, conjugate_summary
from bayes_ops.operators.joins import join_groups
from bayes_ops.operators.suffstats import event_counts, validate_group_by
from bayes_ops.sources.schemas import POISSON_EXPOSURE_COLUMN


def _as_datetime(v) -> _dt.datetime:
    if isinstance(v, _dt.datetime):
        return v if v.tzinfo is None else v.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    if isinstance(v, _dt.date):
        return _dt.datetime(v.year, v.month, v.day)
    return _dt.datetime.fromisoformat(str(v).replace("Z", ""))


def window_exposure(start, end, unit: str = "day", population: float = 1.0) -> float:
    """population x (end - start) in ``unit`` (op A6)."""
    secs = (_as_datetime(end) - _as_datetime(start)).total_seconds()
    return float(population) * secs / unit_seconds(unit)


def poisson_params(df: DataFrame, start, end, cohort: Sequence[str] | None = None,
                   event_type: Sequence[str] | None = None,
                   group_by: Sequence[str] = ("cohort",), unit: str = "day",
                   population: float = 1.0, exposure_col: str | None = "auto",
                   prior: tuple[float, float] = (1.0, 1.0),
                   groups: DataFrame | None = None) -> DataFrame:
    """Per group: n_events, exposure, alpha, beta (ops A5, A6, P10).

    ``groups`` (optional frame of group keys) keeps groups with no event in
    the window, with k = 0; by default they are absent, as in the reference.
    ``exposure_col``: a column to sum; "auto" takes ``exposure`` when the table
    has it, None the window; a named column that is absent is an error.
    """
    gb = validate_group_by(group_by)  # validated before anything runs (Q6)
    if exposure_col == "auto":
        exposure_col = POISSON_EXPOSURE_COLUMN if POISSON_EXPOSURE_COLUMN in df.columns else None
    elif exposure_col and exposure_col not in df.columns:
        raise ValueError(f"the table has no exposure column '{exposure_col}'")
    preds = (flt.time_window(start, end) + flt.membership("cohort", cohort)
             + flt.membership("event_type", event_type))
    stats = event_counts(flt.apply(df, preds), gb, exposure_col)
    if groups is not None:
        stats = (join_groups(groups.select(*gb).distinct(), stats, gb, "left")
                 .withColumn("n_events", F.coalesce(F.col("n_events"), F.lit(0).cast("long"))))
    if not exposure_col:
        stats = stats.withColumn("exposure", F.lit(window_exposure(start, end, unit, population)))
    a0, b0 = prior
    return (stats
            .withColumn("group_key", F.concat_ws(":", *[F.col(c).cast("string") for c in gb]))
            .withColumn("param", F.lit("rate"))
            .withColumn("alpha", F.lit(float(a0)) + F.col("n_events").cast("double"))
            .withColumn("beta", F.lit(float(b0)) + F.col("exposure")))


def poisson_posterior(df: DataFrame, start, end, **kw) -> DataFrame:
    """Posterior summary of the rate per group (op P4)."""
    params = poisson_params(df, start, end, **kw)
    keys = validate_group_by(kw.get("group_by", ("cohort",))) + ["param"]
    out = conjugate_summary(params, keys, "gamma")
    return out.select(*keys[:-1], "group_key", "param", "n_events", "exposure", "alpha", "beta",
                      "mean", "sd", "median", "hdi_3", "hdi_97")


def poisson_curve(df: DataFrame, start, end, **kw) -> DataFrame:
    """Posterior density curve of the rate per group (op P7)."""
    params = poisson_params(df, start, end, **kw)
    keys = validate_group_by(kw.get("group_by", ("cohort",))) + ["param"]
    return conjugate_curve(params, keys, "gamma")


def rescale(summary: DataFrame, exposure: DataFrame | None = None,
            unit: str = "day", key: str = "group_key") -> DataFrame:
    """Per-population, per-unit rescaling of a rate summary (op V3).

    d = exposure(group) x {day 1, hour 24, minute 1440, second 86400};
    a missing or zero exposure counts as 1; location and scale statistics are
    divided by d.
    """
    per_day = {"day": 1.0, "hour": 24.0, "minute": 1440.0, "second": 86400.0}[unit]
    s = summary
    if exposure is not None:
        s = s.join(exposure.select(key, F.col("exposure").alias("_pop")), key, "left")
    else:
        s = s.withColumn("_pop", F.lit(None).cast("double"))
    pop = F.when(F.coalesce(F.col("_pop"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_pop"))
    d = pop * F.lit(per_day)
    for c in ("mean", "median", "hdi_3", "hdi_97", "sd"):
        s = s.withColumn(c, F.col(c) / d)
    return s.drop("_pop")
