"""Posterior draws by inverse CDF on the grid, and draw summaries
(ops C4, C5, J5, N4, N6).

Uniforms are a pure function of (seed, group, draw index) (see
``functions.rand``), so draws are identical across retries, partitionings and
engines.  The inverse CDF is an as-of lookup of each uniform in the group's
grid CDF, done as a union of grid rows and draw rows followed by
``last(..., ignorenulls)`` over a window ordered by the CDF: no range join.
Each window partition holds one group's grid plus its draws.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bayes_ops.functions.rand import hash_uniform
from bayes_ops.operators.joins import join_groups
from bayes_ops.operators.grid import GRID_N, family_support, grid_posterior

HDI_PROB = 0.94


def _group_label(keys: Sequence[str]) -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in keys])


def inverse_cdf(grid: DataFrame, draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As-of lookup (op J5): for each draw row (keys, draw_id, u) find the grid
    cell with cdf_prev <= u < cdf and interpolate linearly inside it.

    ``grid`` rows need keys, x_lo, x_hi, w, cdf.
    """
    keys = list(keys)
    g = grid.select(*keys, (F.col("cdf") - F.col("w")).alias("key"), F.lit(0).alias("kind"),
                    F.lit(None).cast("long").alias("draw_id"), F.lit(None).cast("double").alias("u"),
                    (F.col("cdf") - F.col("w")).alias("c_prev"), F.col("w").alias("c_w"),
                    F.col("x_lo").alias("c_lo"), (F.col("x_hi") - F.col("x_lo")).alias("c_dx"))
    d = draws.select(*keys, F.col("u").alias("key"), F.lit(1).alias("kind"), "draw_id", "u",
                     *[F.lit(None).cast("double").alias(c) for c in ("c_prev", "c_w", "c_lo", "c_dx")])
    w = (Window.partitionBy(*keys).orderBy("key", "kind")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = g.unionByName(d)
    for c in ("c_prev", "c_w", "c_lo", "c_dx"):
        u = u.withColumn(c, F.last(c, ignorenulls=True).over(w))
    u = u.where(F.col("kind") == 1)
    frac = F.least(F.greatest((F.col("u") - F.col("c_prev")) / F.col("c_w"), F.lit(0.0)), F.lit(1.0))
    return u.select(*keys, "draw_id", "u", (F.col("c_lo") + frac * F.col("c_dx")).alias("value"))


def uniforms(params: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """(keys, draw_id, u) with n draws per params row."""
    keys = list(keys)
    return (params.select(*keys)
            .withColumn("draw_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
            .withColumn("u", hash_uniform(F.lit(seed), _group_label(keys), F.col("draw_id"))))


def posterior_draws(params: DataFrame, keys: Sequence[str], family: str, n: int = 1000,
                    seed: int = 0, a: str = "alpha", b: str = "beta",
                    grid_n: int = GRID_N, label_keys: Sequence[str] | None = None) -> DataFrame:
    """n draws per group from a Beta/Gamma posterior (ops C4, C5)."""
    keys = list(keys)
    lo, hi, logp, t = family_support(family, F.col(a), F.col(b))
    grid = grid_posterior(params, keys, lo, hi, logp, grid_n, t)
    lk = list(label_keys) if label_keys is not None else keys
    u = (params.select(*keys)
         .withColumn("draw_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
         .withColumn("u", hash_uniform(F.lit(seed), _group_label(lk), F.col("draw_id"))))
    return inverse_cdf(grid, u, keys)


def hdi_from_draws(draws: DataFrame, keys: Sequence[str], value: str = "value",
                   prob: float = HDI_PROB) -> DataFrame:
    """Narrowest interval holding floor(prob * n) + 1 sorted draws (op N4).

    Per group: k = floor(prob n); widths v[i+k] - v[i]; the smallest width
    (first on ties) gives (hdi_low, hdi_high).
    """
    keys = list(keys)
    cnt = Window.partitionBy(*keys)
    order = Window.partitionBy(*keys).orderBy(value)
    d = (draws.withColumn("n", F.count(F.lit(1)).over(cnt))
         .withColumn("idx", F.row_number().over(order) - 1))
    d = d.withColumn("k", F.floor(F.lit(prob) * F.col("n")).cast("int"))
    # lead by a per-group offset: self-join on index instead of a variable lead
    hi = d.select(*keys, (F.col("idx") - F.col("k")).alias("idx"), F.col(value).alias("upper"))
    j = join_groups(d, hi, keys + ["idx"])
    best = j.withColumn("width", F.col("upper") - F.col(value)).groupBy(*keys).agg(
        F.min_by(F.struct(F.col(value).alias("lo"), F.col("upper").alias("hi")),
                 F.struct(F.col("width"), F.col("idx"))).alias("b"))
    return best.select(*keys, F.col("b.lo").alias("hdi_low"), F.col("b.hi").alias("hdi_high"))


def quantile_band(draws: DataFrame, keys: Sequence[str], probs: Sequence[float] = (0.025, 0.975),
                  value: str = "value") -> DataFrame:
    """sorted[floor(p (n - 1))] per group, not interpolated (op N6)."""
    keys = list(keys)
    cnt = Window.partitionBy(*keys)
    order = Window.partitionBy(*keys).orderBy(value)
    d = (draws.withColumn("n", F.count(F.lit(1)).over(cnt))
         .withColumn("idx", F.row_number().over(order) - 1))
    aggs = []
    for p in probs:
        name = "q_" + ("%g" % (p * 1000)).replace(".", "_")
        pos = F.floor(F.lit(p) * (F.col("n") - 1))
        aggs.append(F.max(F.when(F.col("idx") == pos, F.col(value))).alias(name))
    aggs.append(F.avg(value).alias("mean"))
    return d.groupBy(*keys).agg(*aggs)


