"""Grid quadrature of one-dimensional posteriors (ops P0, A13, P7, P8).

A posterior known up to a constant is evaluated on ``n`` cell midpoints per
(group, parameter).  Grid rows are generated with ``explode(sequence(..))``
from the small parameter table (no join); all windows share the partitioning
on the group keys, so the whole evaluation costs one shuffle of the grid rows
and each window partition holds exactly ``n`` rows whatever the data size.

Summaries: median by linear interpolation inside the cell where the running
mass crosses 1/2; 94 % HDI as the outer cell edges of the highest-density
cells that hold 94 % of the mass (equal to the narrowest interval for the
unimodal posteriors produced here).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayes_ops.functions.densities import log_beta_kernel, log_gamma_kernel

GRID_N = 2000
CURVE_N = 200
HDI_PROB = 0.94


def _keys(keys: Sequence[str]) -> list[str]:
    return list(keys)


# Grid transforms x = T(u), u uniform on (0, 1) (codes stored in column g_t):
#   0: x = lo + (hi - lo) u                       (identity)
#   1: x = lo + (hi - lo) u^2                     (Gamma shape < 3: density ~ x^(a-1) at 0)
#   2: x = lo + (hi - lo) (1 - cos(pi u)) / 2     (Beta shapes < 3: both edges)
# With the Jacobian in the weights the integrand behaves like u^(2a-1) at the
# edge, so the midpoint rule keeps its accuracy for small shapes.


def _t_of(u: Column, t: Column, lo: Column, hi: Column) -> Column:
    shape = (F.when(t == 1, u * u)
             .when(t == 2, (F.lit(1.0) - F.cos(F.lit(math.pi) * u)) / 2)
             .otherwise(u))
    return lo + (hi - lo) * shape


def _log_jac(u: Column, t: Column, lo: Column, hi: Column) -> Column:
    d = (F.when(t == 1, F.lit(2.0) * u)
         .when(t == 2, F.lit(math.pi / 2) * F.sin(F.lit(math.pi) * u))
         .otherwise(F.lit(1.0)))
    return F.log(hi - lo) + F.log(d)


def cell_columns(df: DataFrame, lo: str, hi: str, n: int, transform: Column) -> DataFrame:
    """Explode ``n`` cells of [lo, hi] (uniform in u, x = T(u)) with i, x,
    x_lo, x_hi and ljac = log dx/du, for mixtures summed per cell."""
    g = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("g_t", transform)
    u = (F.col("i") + F.lit(0.5)) / F.lit(float(n))
    glo, ghi, gt = F.col(lo), F.col(hi), F.col("g_t")
    return (g.withColumn("x", _t_of(u, gt, glo, ghi))
             .withColumn("x_lo", _t_of(F.col("i") / F.lit(float(n)), gt, glo, ghi))
             .withColumn("x_hi", _t_of((F.col("i") + F.lit(1.0)) / F.lit(float(n)), gt, glo, ghi))
             .withColumn("ljac", _log_jac(u, gt, glo, ghi)))


def grid_posterior(params: DataFrame, keys: Sequence[str], lo: Column, hi: Column,
                   logp: Callable[[Column], Column], n: int = GRID_N,
                   transform: Column | None = None) -> DataFrame:
    """Evaluate ``logp(x)`` on ``n`` cells of [lo, hi] for every params row.

    Cells are uniform in u with x = T(u) (``transform`` code, identity when
    None).  Returns params columns plus ``i, x, x_lo, x_hi, g_du, lp, w, cdf,
    hmass, g_max, g_z``: w is the cell mass, cdf its running sum by i, hmass
    the running mass by decreasing density (for the HDI).
    """
    keys = _keys(keys)
    t = transform if transform is not None else F.lit(0)
    # one row per group becomes n rows: spread the groups over the tasks first
    # (a number of its own: the same as the aggregation's before it would be taken
    # for that one's partitioning, which adaptive execution merges to a few tasks)
    tasks = int(params.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1
    g = (params.repartition(tasks, *keys)
         .withColumn("g_lo", lo)
         .withColumn("g_hi", hi)
         .withColumn("g_t", t)
         .withColumn("g_du", F.lit(1.0 / n))
         .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))
    u = (F.col("i") + F.lit(0.5)) / F.lit(float(n))
    glo, ghi, gt = F.col("g_lo"), F.col("g_hi"), F.col("g_t")
    g = (g.withColumn("x", _t_of(u, gt, glo, ghi))
         .withColumn("x_lo", _t_of(F.col("i") / F.lit(float(n)), gt, glo, ghi))
         .withColumn("x_hi", _t_of((F.col("i") + F.lit(1.0)) / F.lit(float(n)), gt, glo, ghi)))
    g = g.withColumn("lp", logp(F.col("x")))
    g = g.withColumn("lw", F.col("lp") + _log_jac(u, gt, glo, ghi))
    # whole-group frames on the same (keys, i) ordering as the running CDF:
    # max, sum and cdf are evaluated on one sort of the group
    by_i = Window.partitionBy(*keys).orderBy("i")
    whole = by_i.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = by_i.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("g_max", F.max("lw").over(whole))
    g = g.withColumn("e", F.exp(F.col("lw") - F.col("g_max")))
    g = g.withColumn("g_z", F.sum("e").over(whole))
    g = g.withColumn("w", F.col("e") / F.col("g_z"))
    by_density = Window.partitionBy(*keys).orderBy(F.col("lp").desc(), F.col("i")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("cdf", F.sum("w").over(running))
    g = g.withColumn("hmass", F.sum("w").over(by_density))
    return g


def weights_windows(g: DataFrame, keys: Sequence[str], density: str = "w") -> DataFrame:
    """Add cdf (by cell index) and hmass (by decreasing ``density``) to rows
    holding normalised cell masses ``w`` and cell index ``i``.  On uniform
    cells the mass orders like the density; pass the density column when the
    cells are not uniform."""
    keys = _keys(keys)
    running = Window.partitionBy(*keys).orderBy("i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    by_density = Window.partitionBy(*keys).orderBy(F.col(density).desc(), F.col("i")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (g.withColumn("cdf", F.sum("w").over(running))
             .withColumn("hmass", F.sum("w").over(by_density)))


def grid_summary_aggs(with_moments: bool = False) -> list[Column]:
    """Aggregates over grid rows: median, hdi_3, hdi_97 (+ grid mean/sd).

    Rows need i, x, x_lo, x_hi, w, cdf, hmass.  The median is interpolated
    inside the cell where the running mass crosses 1/2.  The HDI takes the
    densest cells while their mass stays within 94 % and adds the fraction
    of the next cell that completes it, on the side where that cell lies,
    so the edges are interpolated rather than cell edges.
    """
    cdf, w = F.col("cdf"), F.col("w")
    x_lo, x_hi = F.col("x_lo"), F.col("x_hi")
    prev = cdf - w
    crosses = (prev < F.lit(0.5)) & (cdf >= F.lit(0.5))
    median = F.max(F.when(crosses, x_lo + (F.lit(0.5) - prev) / w * (x_hi - x_lo)))
    full = F.col("hmass") <= F.lit(HDI_PROB)
    edge = ((F.col("hmass") - w) < F.lit(HDI_PROB)) & ~full
    frac = (F.lit(HDI_PROB) - (F.col("hmass") - w)) / w
    aggs = [
        median.alias("median"),
        F.min(F.when(full, x_lo)).alias("_f_lo"),
        F.max(F.when(full, x_hi)).alias("_f_hi"),
        F.max(F.when(edge, x_lo)).alias("_e_lo"),
        F.max(F.when(edge, x_hi)).alias("_e_hi"),
        F.max(F.when(edge, frac)).alias("_e_f"),
        F.first("g_max").alias("g_max"),
        F.first("g_z").alias("g_z"),
    ]
    if with_moments:
        gm = F.sum(w * F.col("x"))
        aggs += [gm.alias("grid_mean"),
                 F.sqrt(F.greatest(F.sum(w * F.col("x") * F.col("x")) - gm * gm, F.lit(0.0)))
                 .alias("grid_sd")]
    return aggs


def hdi_columns(df: DataFrame) -> DataFrame:
    """hdi_3 / hdi_97 from the aggregates of ``grid_summary_aggs``."""
    f_lo, f_hi = F.col("_f_lo"), F.col("_f_hi")
    e_lo, e_hi, ef = F.col("_e_lo"), F.col("_e_hi"), F.col("_e_f")
    part = ef * (e_hi - e_lo)
    alone = f_lo.isNull()  # one cell holds more than 94 %: centre the part in it
    left = e_hi <= f_lo
    hdi_3 = (F.when(alone, e_lo + (e_hi - e_lo - part) / 2)
             .when(e_lo.isNull(), f_lo)
             .when(left, e_hi - part).otherwise(f_lo))
    hdi_97 = (F.when(alone, e_hi - (e_hi - e_lo - part) / 2)
              .when(e_lo.isNull(), f_hi)
              .when(left, f_hi).otherwise(e_lo + part))
    return (df.withColumn("hdi_3", hdi_3).withColumn("hdi_97", hdi_97)
            .drop("_f_lo", "_f_hi", "_e_lo", "_e_hi", "_e_f"))


# ---- conjugate families -------------------------------------------------

def _tail_k(shape_small: Column) -> Column:
    """Support half-width in sd: 20 for skewed small shapes, else 12."""
    return F.when(shape_small, F.lit(20.0)).otherwise(F.lit(12.0))


def family_moments(family: str, a: Column, b: Column) -> tuple[Column, Column]:
    if family == "gamma":
        return a / b, F.sqrt(a) / b
    if family == "beta":
        s = a + b
        return a / s, F.sqrt(a * b / (s * s * (s + F.lit(1.0))))
    raise ValueError(family)


def family_support(family: str, a: Column, b: Column
                   ) -> tuple[Column, Column, Callable[[Column], Column], Column]:
    """(lo, hi, log kernel, grid transform code) of a Gamma or Beta posterior."""
    mean, sd = family_moments(family, a, b)
    if family == "gamma":
        small = a < 3
        k = _tail_k(small)
        lo = F.greatest(F.lit(0.0), mean - k * sd)
        hi = mean + k * sd
        return lo, hi, lambda x: log_gamma_kernel(x, a, b, mean), F.when(small, F.lit(1)).otherwise(F.lit(0))
    small = F.least(a, b) < 3
    k = _tail_k(small)
    lo = F.greatest(F.lit(0.0), mean - k * sd)
    hi = F.least(F.lit(1.0), mean + k * sd)
    return lo, hi, lambda x: log_beta_kernel(x, a, b, mean), F.when(small, F.lit(2)).otherwise(F.lit(0))


def _carry(params: DataFrame, keys: Sequence[str]) -> list[Column]:
    """first() of every non-key params column: constant within a group, so the
    summary needs no join back to params (which would re-scan the source)."""
    return [F.first(c).alias(c) for c in params.columns if c not in keys]


def conjugate_summary(params: DataFrame, keys: Sequence[str], family: str,
                      a: str = "alpha", b: str = "beta", n: int = GRID_N) -> DataFrame:
    """Posterior summary per params row for a Beta or Gamma posterior.

    Output: params columns + mean, sd (closed form), median, hdi_3, hdi_97.
    """
    keys = _keys(keys)
    ac, bc = F.col(a), F.col(b)
    lo, hi, logp, t = family_support(family, ac, bc)
    grid = grid_posterior(params, keys, lo, hi, logp, n, t)
    # params columns are constant within a group: grouping by them (instead of
    # first()) keeps a hash aggregate, and the grid's partitioning on ``keys``
    # already satisfies the grouping, so no shuffle and no extra sort
    out = hdi_columns(grid.groupBy(*params.columns).agg(*grid_summary_aggs())).drop("g_max", "g_z")
    mean, sd = family_moments(family, ac, bc)
    return out.withColumn("mean", mean).withColumn("sd", sd)


def conjugate_curve(params: DataFrame, keys: Sequence[str], family: str,
                    a: str = "alpha", b: str = "beta", n: int = GRID_N,
                    points: int = CURVE_N) -> DataFrame:
    """Exact posterior density at ``points`` equally spaced x (op P7).

    x spans mean +- 5 sd clipped to the support; the density is normalised
    with the grid integral, so it integrates to one on the same quadrature.
    """
    keys = _keys(keys)
    ac, bc = F.col(a), F.col(b)
    lo, hi, logp, t = family_support(family, ac, bc)
    grid = grid_posterior(params, keys, lo, hi, logp, n, t)
    norm = grid.groupBy(*keys).agg(*_carry(params, keys),
                                   F.first("g_max").alias("g_max"),
                                   F.first("g_z").alias("g_z"),
                                   F.first("g_du").alias("g_du"))
    mean, sd = family_moments(family, ac, bc)
    dom_hi = F.lit(1.0) if family == "beta" else mean + F.lit(5.0) * sd
    c_lo = F.greatest(F.lit(0.0), mean - F.lit(5.0) * sd)
    c_hi = F.least(dom_hi, mean + F.lit(5.0) * sd)
    cur = (norm.withColumn("c_lo", c_lo)
           .withColumn("c_dx", (c_hi - F.col("c_lo")) / F.lit(float(points)))
           .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))))
    cur = cur.withColumn("x", F.col("c_lo") + (F.col("j") + F.lit(0.5)) * F.col("c_dx"))
    # integral of f = e^g_max * g_z * du on the transformed grid
    cur = cur.withColumn("y", F.exp(logp(F.col("x")) - F.col("g_max"))
                         / (F.col("g_z") * F.col("g_du")))
    return cur.select(*keys, "j", "x", "y")
