"""Hierarchical Gamma-Poisson rates (op P11): cohort rates partially pooled
within each event type.

Model: lambda_c ~ Gamma(shape a, rate b) per event type, k_c ~ Poisson(lambda_c T_c);
hyper-priors a, b ~ HalfCauchy(10) (the reference plan leaves them open; we
state this choice).  Integrating lambda_c out gives the negative-binomial
marginal

  log p(k | a, b) = lgamma(a + k) - lgamma(a) - lgamma(k + 1)
                    + a log(b / (b + T)) + k log(T / (b + T)).

The hyper-posterior of each event type is evaluated at nodes in
(log a, log m) with m = a / b the mean rate (Jacobian a b) by
``operators.hierarchy``: arrays in one row per event type and chunk of cohorts, no row per
(cohort, node).  Each log-shape row has its own log-mean nodes, placed by the
information the cohorts give on it at that shape (the posterior is sharp in m
when a is large and diffuse when a is small).  Each cohort's rate posterior is the
weighted mixture of Gamma(a + k_c, b + T_c): exact moments over the nodes, median and
HDI from its density on ``CELLS`` cells, an array in the cohort's row.

Data enter through one aggregation: k per (event type, cohort).  Nothing per
event type passes through the driver, and an event type with any number of
cohorts is spread over its chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.functions.densities import log_half_cauchy
from bayes_ops.functions.special import lgamma, lgamma_ratio
from bayes_ops.operators import filters as flt
from bayes_ops.operators.arrays import edge_cdf, let, narrowest, quantile_at, total
from bayes_ops.operators.hierarchy import Model, hyper_nodes, mixture_density
from bayes_ops.operators.joins import join_groups
from bayes_ops.operators.materialize import reliable_checkpoint, spread
from bayes_ops.plans.poisson import window_exposure

HC_SCALE = 10.0
REACH = 14.0             # the hyper-prior falls like exp(-2 |log a|) on both sides
LM_SDS = 9.0
FLAT = 45.0              # half range of log m where the units say little: the prior falls like exp(-|log m|)
CELLS = 512
SDS = 7.5


def _info(u: Column, o: Column) -> tuple[Column, Column]:
    """A unit's information on log m given the shape, and that times its rate."""
    each = F.lit(1.0) / (F.exp(-o) + F.lit(1.0) / (F.col("m0") * u["t"]))
    return each, each * u["k"] / u["t"]


def _mean_range(o: Column, w: Column, wm: Column) -> tuple[Column, Column, Column]:
    """Range of log m.  Below an information of 2 the prior counts too: the range then takes in its peak."""
    m = F.log(F.when(wm > 0, wm / w).otherwise(F.col("m0")))
    peak, known = o - F.lit(math.log(HC_SCALE)), w >= 2
    half = F.when(known, F.lit(LM_SDS) / F.sqrt(w) + F.lit(40.0) / w).otherwise(F.lit(FLAT))
    return (F.when(known, m).otherwise(F.least(m, peak)) - half, F.when(known, m).otherwise(F.greatest(m, peak)) + half, w)


def _term(u: Column, o: Column, x: Column) -> Column:
    # without lgamma(k + 1), the same at every node
    b = F.exp(o - x)
    return lgamma_ratio(F.exp(o), u["k"]) - F.exp(o) * F.log1p(u["t"] / b) - u["k"] * F.log1p(b / u["t"])


def _prior(o: Column, x: Column) -> Column:
    return log_half_cauchy(F.exp(o), HC_SCALE) + log_half_cauchy(F.exp(o - x), HC_SCALE) + 2.0 * o - x


MODEL = Model(
    consts=lambda: [((F.sum("k") + F.lit(0.5)) / F.sum("t")).alias("m0"), F.max("k").alias("most")],
    outer=lambda: (F.lit(-REACH), F.lit(math.log(HC_SCALE) + REACH) + F.log1p("most")),
    info=_info, inner=_mean_range, row_term=lambda u, o: F.lit(0.0), term=_term, prior=_prior)


def hier_poisson_posterior(df: DataFrame, start, end, pool_by: str = "event_type",
                           unit_by: str = "cohort", unit: str = "day", population: float = 1.0,
                           cells: int = CELLS, units: DataFrame | None = None) -> DataFrame:
    """Per (event type, cohort): partially pooled posterior of the rate.

    ``units`` (optional frame of (pool_by, unit_by) pairs) adds cohorts with
    no event in the window as k = 0; by default only observed pairs pool,
    as with the plain Poisson plan.
    """
    T = window_exposure(start, end, unit, population)
    counts = (flt.apply(df, flt.time_window(start, end)).groupBy(pool_by, unit_by)
              .agg(F.count(F.lit(1)).alias("k")))
    if units is not None:
        counts = (join_groups(units.select(pool_by, unit_by).distinct(), counts, [pool_by, unit_by], "left")
                  .withColumn("k", F.coalesce(F.col("k"), F.lit(0).cast("long"))))
    stats = counts.select(F.col(pool_by).cast("string").alias("g"), F.col(unit_by).alias("unit"), "k",
                          F.lit(float(T)).alias("T"))
    return (pooled_rates(stats, cells).withColumnRenamed("g", pool_by).withColumnRenamed("unit", unit_by)
            .withColumn("exposure", F.lit(float(T)))
            .select(pool_by, unit_by, "n_events", "exposure", "mean", "sd", "median", "hdi_3", "hdi_97"))


def pooled_rates(stats: DataFrame, cells: int = CELLS) -> DataFrame:
    """Per (g, unit) of counts (g, unit, k, T): the pooled posterior of its rate."""
    stats = reliable_checkpoint(stats)   # one row per unit, read by every pass
    units = stats.select("g", "unit", F.col("k").cast("double").alias("k"), F.col("T").alias("t"))
    nodes = hyper_nodes(units, ["k", "t"], MODEL)
    k, t = F.col("k").cast("double"), F.col("T")

    def component(n: Column) -> Column:
        def shape(c: Column) -> Column:
            m = c["a"] / c["b"]
            sd = F.sqrt(c["a"]) / c["b"]
            # the mean moves by this much from one node of the row to the next
            wide = F.greatest(sd, 0.7 * n["h"] * m * c["hb"] / c["b"])

            def made(v: Column) -> Column:
                a = F.when(v["wide"] > v["sd"], (m / v["wide"]) * (m / v["wide"])).otherwise(c["a"])
                return F.struct(n["w"].alias("w"), m.alias("m"), v["wide"].alias("sd"), (v["sd"] * v["sd"]).alias("var"),
                                ((v["sd"] / v["wide"]) * (v["sd"] / v["wide"])).alias("r"), a.alias("a"),
                                (a * F.log(a) - a - lgamma(a)).alias("ln"))
            return let(F.struct(sd.alias("sd"), wide.alias("wide")), made)
        return let(F.exp(n["o"] - n["x"]), lambda hb: let(
            F.struct(hb.alias("hb"), (F.exp(n["o"]) + k).alias("a"), (hb + t).alias("b")), shape))

    def logpdf(c: Column, p: Column) -> Column:
        # Gamma(a, a / m) at x = m (1 + r): log density a (log1p(r) - r) - log x + constant
        return let((p["x"] - c["m"]) / c["m"], lambda r: c["a"] * (F.log1p(r) - r) - p["lx"] + c["ln"])

    def points(lo: Column, hi: Column, square: Column) -> Column:
        def cell(u: Column) -> Column:
            x = lo + (hi - lo) * F.when(square == 1, u * u).otherwise(u)
            return F.struct(x.alias("x"), F.log(x).alias("lx"), F.when(square == 1, 2.0 * u).otherwise(F.lit(1.0)).alias("jac"))
        return F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: let((i + F.lit(0.5)) / F.lit(float(cells)), cell))

    rows = join_groups(spread(stats, "g", "unit"), nodes, ["g"]).withColumn("comps", F.transform("nodes", component)).drop("nodes")
    weight = total(F.col("comps"), lambda c: c["w"])
    rows = reliable_checkpoint(spread(reliable_checkpoint(rows), "g", "unit").withColumn(
        "mean", total(F.col("comps"), lambda c: c["w"] * c["m"]) / weight))
    rows = rows.withColumn("sd", F.sqrt(total(F.col("comps"), lambda c: c["w"] * (
        c["var"] + (c["m"] - F.col("mean")) * (c["m"] - F.col("mean"))))))
    felt = F.filter("comps", lambda c: c["w"] > 1e-9)
    rows = rows.withColumn("lo", F.greatest(F.lit(0.0), F.array_min(F.transform(felt, lambda c: c["m"] - SDS * c["sd"])))) \
        .withColumn("hi", F.array_max(F.transform(felt, lambda c: c["m"] + SDS * c["sd"])))
    # cells uniform in u; x = hi u^2 where the support starts at 0 and components behave like x^(a-1)
    rows = rows.withColumn("square", F.when(F.col("lo") <= 0, 1).otherwise(0))
    rows = reliable_checkpoint(rows.withColumn("xs", points(F.col("lo"), F.col("hi"), F.col("square"))))
    rows = reliable_checkpoint(rows.withColumn("f", mixture_density(F.col("comps"), F.col("xs"), logpdf)).drop("comps"))
    mass = F.zip_with("f", "xs", lambda f, p: f * p["jac"])
    rows = reliable_checkpoint(rows.withColumn("cdf", edge_cdf(mass)))

    def x_at(position: Column) -> Column:
        u = position / float(cells)
        return F.col("lo") + (F.col("hi") - F.col("lo")) * F.when(F.col("square") == 1, u * u).otherwise(u)
    hdi = F.transform(narrowest(F.col("f"), F.col("cdf")), x_at)
    rows = rows.withColumn("median", let(quantile_at(F.col("cdf"), F.lit(0.5)), x_at)).withColumn("hdi", hdi)
    return reliable_checkpoint(rows.select("g", "unit", F.col("k").alias("n_events"), "mean", "sd", "median",
                                           F.col("hdi")[0].alias("hdi_3"), F.col("hdi")[1].alias("hdi_97")))
