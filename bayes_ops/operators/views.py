"""Derived views behind the charts (ops V1, V2, V5, V6, V7, V8).

Densities are computed where the data lives: every kernel evaluation is a
row produced by ``explode`` and summed by a partial (map-side) aggregation
keyed by (group, tick), so nothing is gathered per group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayes_ops.functions.densities import gaussian_kernel, weibull_pdf
from bayes_ops.operators.joins import join_groups
from bayes_ops.operators.materialize import reliable_checkpoint
from bayes_ops.operators.quantiles import grouped_percentiles

TICKS = 200


def _stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("v_min"), F.max(value).alias("v_max"))


def gaussian_kde(df: DataFrame, keys: Sequence[str], value: str, points: int = TICKS) -> DataFrame:
    """Gaussian KDE per group on ``points`` x from min to max (op V1).

    Bandwidth h: sample sd x n^(-1/5) (Scott).  Rows are reduced map-side to
    cells an eighth of a bandwidth wide, as many as the data occupy; a cell
    keeps the sums of (offset / h)^0..5, from which the kernel sum follows by
    its Hermite series (within 1e-9 of the sum over all rows).  A cell meets
    the points within 9 h of it.  One row per value enters the aggregation.

    A group without spread (one row, or equal values) has y NULL.
    """
    keys = list(keys)
    if {"j", "x", "y"} & set(keys):
        raise ValueError("group columns must not be called j, x or y")
    st = _stats(df, keys, value).select(
        *keys, F.col("n").alias("_n"), F.nullif(F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)), F.lit(0.0)).alias("_h"),
        F.col("v_min").cast("double").alias("_min"),
        ((F.col("v_max") - F.col("v_min")) / F.lit(float(points - 1))).alias("_step"))
    q = (F.col(value) - F.col("_min")) / F.col("_h")
    cells = (join_groups(df.where(F.col(value).isNotNull()).select(*keys, value), st.where(F.col("_h").isNotNull()), keys)
             .select(*keys, "_h", "_step", F.floor(q * 8).alias("_cell"), q.alias("_q"))
             .withColumn("_d", F.col("_q") - (F.col("_cell") + F.lit(0.5)) / 8))
    d = F.col("_d")
    powers = [F.lit(1.0), d, d * d, d * d * d, d * d * d * d, d * d * d * d * d]
    sums = cells.groupBy(*keys, "_cell").agg(
        F.first("_h").alias("_h"), F.first("_step").alias("_step"),
        *[F.sum(e).alias(f"_s{k}") for k, e in enumerate(powers)])
    at, gap = (F.col("_cell") + F.lit(0.5)) / 8, F.col("_step") / F.col("_h")
    near = (sums.withColumn("_from", F.greatest(F.lit(0), F.ceil((at - 9) / gap)))
            .withColumn("_to", F.least(F.lit(points - 1), F.floor((at + 9) / gap)))
            .where(F.col("_from") <= F.col("_to"))
            .withColumn("j", F.explode(F.sequence(F.col("_from").cast("int"), F.col("_to").cast("int")))))
    near = near.withColumn("_u", F.col("j") * gap - at)
    u = F.col("_u")
    hermite = [F.lit(1.0), u, u * u - 1, u * (u * u - 3), u * u * (u * u - 6) + 3, u * (u * u * (u * u - 10) + 15)]
    series = sum((F.col(f"_s{k}") * hermite[k] / F.lit(float(math.factorial(k))) for k in range(1, 6)), F.col("_s0"))
    dens = near.groupBy(*keys, "j").agg(F.sum(gaussian_kernel(u, F.lit(1.0)) * series).alias("_k"))
    ticks = st.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return join_groups(ticks, dens, [*keys, "j"], "left").select(
        *keys, "j", (F.col("_min") + F.col("j") * F.col("_step")).alias("x"),
        (F.coalesce("_k", F.lit(0.0)) / (F.col("_n") * F.col("_h"))).alias("y"))


def epanechnikov_timeline(df: DataFrame, keys: Sequence[str], ts: str = "timestamp",
                          ticks: int = TICKS) -> DataFrame:
    """Timeline density per group (op V2), exact.

    Times in epoch milliseconds; ``ticks`` equally spaced points over the
    global [min, max]; bandwidth 1.06 sd n^-0.2 (sd fallback 1e-9).

    Inside its support the kernel is a quadratic in the event's time, so events that
    reach the same ticks need only be counted and have their first two moments taken.  Each event is
    one row, grouped map-side by the first and last tick that it reaches; the few sums are then
    spread over those ticks.  The table is read twice: extent and bandwidths, then the sums.
    """
    keys = list(keys)
    ms = F.unix_millis(F.col(ts)).cast("double")
    ev = df.where(F.col(ts).isNotNull()).select(*keys, ms.alias("v"))
    st = reliable_checkpoint(ev.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"),
                                                   F.min("v").alias("t0"), F.max("v").alias("t1")))
    ext = st.agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).first()
    t0, t1 = ext["t0"], ext["t1"]
    if t0 is None:
        return df.sparkSession.createDataFrame([], "j int, tick double, density double")
    step = (t1 - t0) / (ticks - 1) if t1 > t0 else 1.0
    sd = F.when(F.col("sd").isNull() | (F.col("sd") == 0), F.lit(1e-9)).otherwise(F.col("sd"))
    st = st.drop("t0", "t1").withColumn("h", F.lit(1.06) * sd / F.pow(F.col("n").cast("double"), F.lit(0.2)))
    v, h = F.col("v"), F.col("h")
    tick_of = lambda j: F.lit(t0) + j * F.lit(step)
    # the ticks within h of the event; the guess by division is put right by comparing the ticks themselves
    guess_a = F.ceil((v - h - F.lit(t0)) / F.lit(step)).cast("int")
    guess_b = F.floor((v + h - F.lit(t0)) / F.lit(step)).cast("int")
    near = lambda j: F.abs((tick_of(j) - v) / h) <= 1
    a = F.when(near(guess_a - 1), guess_a - 1).when(near(guess_a), guess_a).otherwise(guess_a + 1)
    b = F.when(near(guess_b + 1), guess_b + 1).when(near(guess_b), guess_b).otherwise(guess_b - 1)
    reach = join_groups(ev, st.select(*keys, "h"), keys).select(
        *keys, "h", v, F.greatest(a, F.lit(0)).alias("_a"), F.least(b, F.lit(ticks - 1)).alias("_b")).where("_a <= _b")
    off = (v - tick_of(F.col("_a"))) / h                # from the first tick it reaches, in bandwidths
    sums = reach.groupBy(*keys, "h", "_a", "_b").agg(F.count("*").alias("_c"), F.sum(off).alias("_s1"), F.sum(off * off).alias("_s2"))
    ex = sums.withColumn("j", F.explode(F.sequence("_a", "_b")))
    d = (F.col("j") - F.col("_a")) * F.lit(step) / h
    ex = ex.withColumn("k", F.lit(0.75) / h * (F.col("_c") - (F.col("_c") * d * d - 2.0 * d * F.col("_s1") + F.col("_s2"))))
    dens = ex.groupBy(*keys, "j").agg(F.sum("k").alias("ksum"))
    grid = (st.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))))
            .withColumn("tick", tick_of(F.col("j"))))
    return (join_groups(grid, dens, keys + ["j"], "left")
            .withColumn("density", F.coalesce(F.col("ksum"), F.lit(0.0)) / F.col("n"))
            .select(*keys, "j", "tick", "n", "density"))


def shared_axis(curves: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """x extent and 1.1 x max density over all groups' curves (op V7)."""
    return curves.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"),
                      (F.max(y) * F.lit(1.1)).alias("y_max"))


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles (linear interpolation), whiskers at the most extreme values
    within 1.5 IQR of the box, and the outlier count (op V8)."""
    keys = list(keys)
    q = reliable_checkpoint(grouped_percentiles(df, keys, value, [0.25, 0.5, 0.75]))
    q = q.select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = q.withColumn("lo_fence", F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1")))
    v = F.col(value)
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    w = join_groups(df, q, keys).groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_lo"), F.max(F.when(inside, v)).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"))
    return w


def weibull_traces(alpha_draws: DataFrame, beta_draws: DataFrame, points: int = TICKS) -> DataFrame:
    """Sampled Weibull pdfs (op V5) and the constant-hazard reference (V6).

    ``alpha_draws`` / ``beta_draws``: (draw_id, value), drawn independently
    from the two marginals as in the reference.  x = eps + k x_max/200 with
    x_max = 1.5 x the 95 % quantile of the beta draws (or 1), eps = x_max/1e4.
    The reference trace uses alpha = 1 and beta = median of the beta draws.
    """
    q = beta_draws.agg(F.percentile("value", F.array(F.lit(0.95), F.lit(0.5))).alias("q")).first()["q"]
    x_max = (q[0] * 1.5) if q and q[0] else 1.0
    med = q[1] if q else None
    eps = x_max / 10000.0
    pairs = (alpha_draws.select("draw_id", F.col("value").alias("alpha"))
             .join(beta_draws.select("draw_id", F.col("value").alias("beta")), "draw_id"))
    ref = pairs.sparkSession.createDataFrame([(-1, 1.0, float(med) if med else None)],
                                             "draw_id long, alpha double, beta double")
    lines = pairs.unionByName(ref.where(F.col("beta").isNotNull()))
    x = F.lit(eps) + F.col("k") * F.lit(x_max / points)
    return (lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumn("x", x)
            .withColumn("y", weibull_pdf(F.col("x"), F.col("alpha"), F.col("beta")))
            .withColumn("reference", F.col("draw_id") < 0))


