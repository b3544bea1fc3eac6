"""Hierarchical A/B test (ops A2, P2).

Model (reference): alpha, beta ~ HalfCauchy(10); p_v ~ Beta(alpha, beta);
outcomes ~ Bernoulli(p_v).  Integrating p_v out, the hyper-posterior is

  log p(alpha, beta | data) = sum_v [logB(alpha + s_v, beta + f_v) - logB(alpha, beta)]
                              + log HC(alpha) + log HC(beta)

evaluated at nodes in (log kappa, logit mu) with alpha = mu kappa,
beta = (1 - mu) kappa (Jacobian kappa^2 mu (1 - mu)).  The data enter only through
(s_v, f_v) per variant: one aggregation over the trial rows.  The posterior is
sharp in mu at large kappa and diffuse at small kappa, so every log-kappa row has its
own mu nodes, placed by the information that the variants give on mu at that kappa.
The quadrature is ``operators.hierarchy``: arrays in one row, no row per (variant, node).

Each variant's posterior of p_v is the weighted mixture of
Beta(alpha_g + s_v, beta_g + f_v); its moments are exact sums over the nodes, its median
and HDI come from the mixture density on ``P_CELLS`` cells, an array in the variant's row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.functions.densities import log_half_cauchy
from bayes_ops.functions.special import lgamma_ratio, log_beta_fn
from bayes_ops.operators.arrays import edge_cdf, let, narrowest, quantile_at, total
from bayes_ops.operators.filters import project
from bayes_ops.operators.hierarchy import Model, hyper_nodes, mixture_density
from bayes_ops.operators.joins import join_groups
from bayes_ops.operators.materialize import reliable_checkpoint, spread
from bayes_ops.operators.suffstats import ab_stats

HC_SCALE = 10.0
REACH = 14.0             # the hyper-prior falls like exp(-2 |log kappa|) on both sides
MU_SDS = 9.0
P_CELLS = 512
P_SDS = 7.5
CURVE_N = 200


def _alpha_beta(o: Column, x: Column) -> tuple[Column, Column]:
    """alpha, beta at log kappa and logit mu."""
    return F.exp(o - F.log1p(F.exp(-x))), F.exp(o - F.log1p(F.exp(x)))


def _info(u: Column, o: Column) -> tuple[Column, Column]:
    t = u["s"] + u["f"] + 1.0
    w = F.lit(1.0) / (1.0 / t + 1.0 / (F.exp(o) + 1.0))
    return w, w * (u["s"] + 0.5) / t


def _mu_range(o: Column, w: Column, wm: Column) -> tuple[Column, Column, Column]:
    """Range of logit mu about the pooled rate, and the information on it.  Both tails fall like exp(-|x|) at least."""
    m = wm / w
    info = w * m * (1.0 - m)
    half = F.lit(MU_SDS) / F.sqrt(info) + F.lit(30.0) / (1.0 + info)
    centre = F.log(m) - F.log1p(-m)
    return centre - half, centre + half, info


def _term(u: Column, o: Column, x: Column) -> Column:
    a, b = _alpha_beta(o, x)
    return lgamma_ratio(a, u["s"]) + lgamma_ratio(b, u["f"])


def _prior(o: Column, x: Column) -> Column:
    a, b = _alpha_beta(o, x)
    return (log_half_cauchy(a, HC_SCALE) + log_half_cauchy(b, HC_SCALE) + 2.0 * o
            - F.log1p(F.exp(-x)) - F.log1p(F.exp(x)))


MODEL = Model(
    consts=lambda: [F.max(F.col("s") + F.col("f")).alias("most")],
    outer=lambda: (F.lit(-REACH), F.lit(math.log(HC_SCALE) + REACH) + F.log1p("most")),
    info=_info, inner=_mu_range, row_term=lambda u, o: -lgamma_ratio(F.exp(o), u["s"] + u["f"]), term=_term, prior=_prior)


def ab_posterior(df: DataFrame, p_cells: int = P_CELLS) -> DataFrame:
    """Per variant: successes, trials and the posterior summary of p_v."""
    return variant_posteriors(_stats(df), p_cells)


def ab_curve(df: DataFrame, points: int = CURVE_N) -> DataFrame:
    """Per variant: posterior density of p_v at ``points`` x over mean +- 5 sd within [0, 1] (P7 for P2)."""
    rows = _mixtures(_stats(df))
    lo = F.greatest(F.lit(0.0), F.col("mean") - 5.0 * F.col("sd"))
    hi = F.least(F.lit(1.0), F.col("mean") + 5.0 * F.col("sd"))
    rows = reliable_checkpoint(rows.withColumn("xs", _points(lo, hi, points, F.lit(0))))
    curve = rows.withColumn("y", mixture_density(F.col("comps"), F.col("xs"), _logpdf))
    pairs = F.arrays_zip(F.col("xs").alias("xs"), F.col("y").alias("y"))
    return curve.select("variant", F.posexplode(pairs).alias("i", "p")).select(
        "variant", "i", F.col("p.xs.x").alias("x"), F.col("p.y").alias("y"))


def _stats(df: DataFrame) -> DataFrame:
    return ab_stats(project(df, ["variant", "outcome"])).select("variant", "successes", "trials", "failures")


def _points(lo: Column, hi: Column, n: int, square: Column) -> Column:
    """n cell middles of [lo, hi] as (x, log x, log(1 - x), jac); x = lo + (hi - lo) u^2 where ``square``."""
    def at(i: Column) -> Column:
        def cell(u: Column) -> Column:
            x = lo + (hi - lo) * F.when(square == 1, u * u).otherwise(u)
            return F.struct(x.alias("x"), F.log(x).alias("lx"), F.log1p(-x).alias("l1x"),
                            F.when(square == 1, 2.0 * u).otherwise(F.lit(1.0)).alias("jac"))
        return let((i + F.lit(0.5)) / F.lit(float(n)), cell)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def _logpdf(c: Column, p: Column) -> Column:
    return (c["a"] - 1.0) * p["lx"] + (c["b"] - 1.0) * p["l1x"] + c["ln"]


def _mixtures(stats: DataFrame) -> DataFrame:
    """Per variant: its counts, mean, sd and the components (w, m, sd, r, a, b, ln) of its rate's density."""
    stats = reliable_checkpoint(stats)   # one row per variant
    units = stats.select(F.lit(0).alias("g"), F.col("variant").alias("unit"),
                         F.col("successes").cast("double").alias("s"), F.col("failures").cast("double").alias("f"))
    nodes = hyper_nodes(units, ["s", "f"], MODEL)
    s, f = F.col("successes").cast("double"), F.col("failures").cast("double")

    def component(n: Column) -> Column:
        ha, hb = _alpha_beta(n["o"], n["x"])

        def shape(c: Column) -> Column:
            m = c["a"] / (c["a"] + c["b"])
            var = m * (1.0 - m) / (c["a"] + c["b"] + 1.0)
            # the mean moves by this much from one node of the row to the next
            step = n["h"] * c["ha"] * c["hb"] / ((c["ha"] + c["hb"]) * (c["a"] + c["b"]))
            wide = F.least(F.greatest(var, 0.49 * step * step), 0.5 * m * (1.0 - m))

            def made(v: Column) -> Column:
                conc = m * (1.0 - m) / v["wide"] - 1.0
                a = F.when(v["wide"] > v["var"], m * conc).otherwise(c["a"])
                b = F.when(v["wide"] > v["var"], (1.0 - m) * conc).otherwise(c["b"])
                return F.struct(n["w"].alias("w"), m.alias("m"), F.sqrt(v["wide"]).alias("sd"), v["var"].alias("var"),
                                (v["var"] / v["wide"]).alias("r"), a.alias("a"), b.alias("b"), (-log_beta_fn(a, b)).alias("ln"))
            return let(F.struct(var.alias("var"), wide.alias("wide")), made)
        return let(F.struct(ha.alias("ha"), hb.alias("hb"), (ha + s).alias("a"), (hb + f).alias("b")), shape)

    rows = join_groups(spread(stats, "variant").withColumn("g", F.lit(0)), nodes.hint("broadcast"), ["g"])   # one row
    rows = reliable_checkpoint(rows.withColumn("comps", F.transform("nodes", component)).drop("nodes", "g"))
    rows = rows.withColumn("mean", total(F.col("comps"), lambda c: c["w"] * c["m"]) / total(F.col("comps"), lambda c: c["w"]))
    rows = reliable_checkpoint(rows)
    return rows.withColumn("sd", F.sqrt(total(F.col("comps"), lambda c: c["w"] * (
        c["var"] + (c["m"] - F.col("mean")) * (c["m"] - F.col("mean"))))))


def variant_posteriors(stats: DataFrame, p_cells: int = P_CELLS) -> DataFrame:
    """Posterior summaries of (variant, successes, trials, failures)."""
    rows = _mixtures(stats)
    felt = F.filter("comps", lambda c: c["w"] > 1e-9)
    rows = rows.withColumn("lo", F.greatest(F.lit(0.0), F.array_min(F.transform(felt, lambda c: c["m"] - P_SDS * c["sd"])))) \
        .withColumn("hi", F.least(F.lit(1.0), F.array_max(F.transform(felt, lambda c: c["m"] + P_SDS * c["sd"]))))
    # cells uniform in u; x = hi u^2 where the support starts at 0 and components behave like x^(a-1)
    rows = rows.withColumn("square", F.when(F.col("lo") <= 0, 1).otherwise(0))
    rows = reliable_checkpoint(rows.withColumn("xs", _points(F.col("lo"), F.col("hi"), p_cells, F.col("square"))))
    rows = reliable_checkpoint(rows.withColumn("f", mixture_density(F.col("comps"), F.col("xs"), _logpdf)).drop("comps"))
    mass = F.zip_with("f", "xs", lambda f, p: f * p["jac"])
    rows = reliable_checkpoint(rows.withColumn("cdf", edge_cdf(mass)))

    def x_at(position: Column) -> Column:
        u = position / float(p_cells)
        return F.col("lo") + (F.col("hi") - F.col("lo")) * F.when(F.col("square") == 1, u * u).otherwise(u)
    hdi = narrowest(F.col("f"), F.col("cdf"))
    rows = rows.withColumn("median", let(quantile_at(F.col("cdf"), F.lit(0.5)), x_at)).withColumn("hdi", F.transform(hdi, x_at))
    return reliable_checkpoint(rows.select("variant", "successes", "trials", "mean", "sd", "median",
                                           F.col("hdi")[0].alias("hdi_3"), F.col("hdi")[1].alias("hdi_97")))
