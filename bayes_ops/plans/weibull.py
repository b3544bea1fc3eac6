"""Weibull survival posterior (ops A7, P5, E2, E3).

Model (reference): alpha ~ HalfNormal(1), beta ~ HalfNormal(10); observed t
contribute the Weibull log pdf, censored t the log survival -(t/beta)^alpha.
Summed over rows:

  lp(a, b) = r log a - r a log b + (a - 1) L - S(a) b^-a - a^2/2 - b^2/200

with r = #observed, L = sum of log t over observed, S(a) = sum over all rows
of t^a.  The data enter only through r, L and the function S.

Two scans, each one aggregation whose sums are formed map-side:

1. n, r, L, the extent of t, and S on a ladder of ``LADDER`` exponents.  Between them log S is
   interpolated well enough to find where the alpha marginal (its Laplace form) holds mass.
2. S at Chebyshev nodes of that range.  log S is analytic in a strip about the real line of half width
   pi / log(max t / min t) at least, which gives the number of nodes for an error of ``LOG_S_ERROR``; the size of the
   last coefficients confirms it (else the nodes are doubled and the scan repeated).

From then on S(a) is known at any a without the data, so the grid is as fine as is wanted:
``FINAL`` alphas by ``FINAL`` betas; beta spans the conditional posteriors (mode +- 10 sd, prior included, Newton steps
on scalars) of the alphas that carry mass.  No sampler, no chains: deterministic results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.operators.arrays import edge_cdf, narrowest, quantile_at, total
from bayes_ops.operators.materialize import reliable_checkpoint
from bayes_ops.operators.suffstats import power_sums

ALPHA_SIGMA = 1.0
BETA_SIGMA = 10.0
LADDER = [2.0 ** (k / 3) for k in range(-15, 19)]     # 0.03 to 64
LOG_S_ERROR = 1e-11
FINAL = 512
CURVE_N = 200
DROP = 50.0


def _cond_log_beta(a: float, z: float, r: int, log_c: float) -> tuple[float, float, float]:
    """Conditional mode and sd of s = log beta given alpha, with the prior.

    g(s) = -r a s - Z e^(-a s) - e^(2s) / (2 sigma^2) + s   (Z = z c^a; +s: Jacobian)
    Newton steps on scalars; returns (s*, sd, g(s*)).
    """
    log_z = a * log_c + math.log(z)
    s_ = (log_z - math.log(max(r, 1))) / a
    s_ = min(s_, math.log(10 * BETA_SIGMA))
    inv = 1.0 / (BETA_SIGMA ** 2)
    for _ in range(60):
        e1 = math.exp(log_z - a * s_)
        e2 = math.exp(2 * s_)
        g1 = -r * a + a * e1 - e2 * inv + 1.0
        g2 = -a * a * e1 - 2 * e2 * inv
        step = g1 / g2
        step = max(min(step, 1.0), -1.0)
        s_ -= step
        if abs(step) < 1e-12:
            break
    e1 = math.exp(log_z - a * s_)
    e2 = math.exp(2 * s_)
    g2 = -a * a * e1 - 2 * e2 * inv
    g = -r * a * s_ - e1 - e2 * inv / 2 + s_
    return s_, 1.0 / math.sqrt(-g2), g


def beta_range(alphas: list[float], zs: list[float], r: int, L: float, log_c: float) -> tuple[float, float]:
    """Union over the alpha nodes carrying mass of exp(s* +- 10 sd)."""
    rows = []
    for a_, z_ in zip(alphas, zs):
        s_, sd, g = _cond_log_beta(a_, z_, r, log_c)
        # Laplace estimate of the alpha marginal at this node
        lm = r * math.log(a_) + (a_ - 1) * L - a_ * a_ / (2 * ALPHA_SIGMA ** 2) + g + math.log(sd)
        rows.append((lm, s_, sd))
    top = max(x[0] for x in rows)
    kept = [x for x in rows if x[0] > top - 30.0]
    lo = min(math.exp(s_ - 10 * sd) for _, s_, sd in kept)
    hi = max(math.exp(s_ + 10 * sd) for _, s_, sd in kept)
    return lo, hi


def _laplace(a: float, z: float, r: int, L: float, log_c: float) -> float:
    """Laplace estimate of the log marginal of alpha at a, from z = S(a) / c^a."""
    _, sd, g = _cond_log_beta(a, z, r, log_c)
    return r * math.log(a) + (a - 1) * L - a * a / (2 * ALPHA_SIGMA ** 2) + g + math.log(sd)


class LogS:
    """log S(a) - a log c on [lo, hi] from its values at Chebyshev nodes."""

    def __init__(self, lo: float, hi: float, values: list[float]):
        n = len(values)
        self.lo, self.hi = lo, hi
        self.coefs = [(1 if j == 0 else 2) / n * sum(v * math.cos(math.pi * j * (k + 0.5) / n) for k, v in enumerate(values))
                      for j in range(n)]

    @staticmethod
    def nodes(lo: float, hi: float, n: int) -> list[float]:
        return [(lo + hi) / 2 + (hi - lo) / 2 * math.cos(math.pi * (k + 0.5) / n) for k in range(n)]

    def tail(self) -> float:
        return max(abs(c) for c in self.coefs[-3:])

    def __call__(self, a: float) -> float:
        x = (2 * a - self.lo - self.hi) / (self.hi - self.lo)
        b1 = b2 = 0.0
        for c in reversed(self.coefs[1:]):
            b1, b2 = c + 2 * x * b1 - b2, b1
        return self.coefs[0] + x * b1 - b2


def _between(xs: list[float], ys: list[float], x: float) -> float:
    """Cubic through the four nearest points."""
    i = min(max(sum(v <= x for v in xs) - 2, 0), len(xs) - 4)
    out = 0.0
    for j in range(i, i + 4):
        w = 1.0
        for k in range(i, i + 4):
            if k != j:
                w *= (x - xs[k]) / (xs[j] - xs[k])
        out += w * ys[j]
    return out


def _heavy(alphas: list[float], lms: list[float]) -> tuple[int, int]:
    top = max(lms)
    keep = [i for i, v in enumerate(lms) if v > top - DROP]
    return keep[0], keep[-1]


def locate(df: DataFrame) -> tuple[dict, float, float]:
    """First scan: n, r, L, extent of t, and the alpha range that holds the mass, widened by 3 %.

    Exponents at which a sum leaves the doubles are not used; a range that reaches the last usable one is
    sought again with t scaled by its maximum, then on ever higher ladders."""
    ladder, scale, stats = LADDER, 1.0, None
    for _ in range(12):
        row = power_sums(df, ladder, scale, with_basic=stats is None).first()
        if stats is None:
            stats = {k: row[k] for k in ("n", "r", "sum_log_t_obs", "max_t", "min_t")}
            if not stats["n"]:
                raise ValueError("the table holds no duration to fit")
        c, r, L = stats["max_t"], stats["r"], stats["sum_log_t_obs"] or 0.0
        log_c = math.log(c)
        sums = [(a, row[f"s{k}"]) for k, a in enumerate(ladder)]
        used = [(math.log(a), math.log(s) + a * (math.log(scale) - log_c)) for a, s in sums if s and 1e-300 < s < 1e300]
        if len(used) >= 4:
            xs, ys = [u[0] for u in used], [u[1] for u in used]
            vs = [xs[0] + i * (xs[-1] - xs[0]) / 1500 for i in range(1501)]
            alphas = [math.exp(v) for v in vs]
            lms = [_laplace(a, math.exp(_between(xs, ys, v)), r, L, log_c) for v, a in zip(vs, alphas)]
            k0, k1 = _heavy(alphas, lms)
            if k1 < len(vs) - 1:
                lo = 1e-6 if k0 == 0 else alphas[max(k0 - 2, 0)] * 0.97
                return stats, lo, alphas[min(k1 + 2, len(vs) - 1)] * 1.03
        if scale != 1.0:
            ladder = [a * 8.0 for a in ladder]
        scale = c
    raise RuntimeError("no exponent range holds the posterior of alpha")


def log_power_sum(df: DataFrame, stats: dict, lo: float, hi: float) -> LogS:
    """Second scan: log S on [lo, hi] to ``LOG_S_ERROR`` (per cent of its own scale the sums' rounding)."""
    spread = math.log(stats["max_t"] / stats["min_t"]) if stats["min_t"] and stats["min_t"] > 0 else 0.0
    y = 2 * (math.pi / max(spread, 1e-3)) / (hi - lo)          # half width of the strip in half ranges
    n = min(max(12, math.ceil(math.log(1 / LOG_S_ERROR) / math.log(y + math.sqrt(1 + y * y))) + 4), 256)
    while True:
        nodes = LogS.nodes(lo, hi, n)
        row = power_sums(df, nodes, stats["max_t"]).first()
        out = LogS(lo, hi, [math.log(row[f"s{k}"]) for k in range(n)])
        if out.tail() <= 100 * LOG_S_ERROR * max(1.0, abs(out.coefs[0])) or n >= 1024:
            return out
        n *= 2


def _grid(spark, alphas: list[float], zs: list[float], betas: tuple[float, float, int], meta: dict) -> DataFrame:
    """(ai, bj, e): the joint density at every alpha and every beta middle of (lo, hi, n)."""
    nodes = spark.createDataFrame([(k, a_, z_) for k, (a_, z_) in enumerate(zip(alphas, zs))], "ai int, alpha double, z double")
    b_lo, b_hi, n = betas
    g = (nodes.repartition(min(8, len(alphas))).withColumn("bj", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
         .withColumn("beta", F.lit(b_lo) + (F.col("bj") + F.lit(0.5)) * F.lit((b_hi - b_lo) / n)))
    a, b, z, r = F.col("alpha"), F.col("beta"), F.col("z"), F.lit(float(meta["r"]))
    lp = (r * F.log(a) - r * a * F.log(b) + (a - 1) * F.lit(float(meta["L"]))
          - F.exp(F.log(z) + a * (F.lit(meta["log_c"]) - F.log(b)))
          - a * a / F.lit(2 * ALPHA_SIGMA ** 2) - b * b / F.lit(2 * BETA_SIGMA ** 2))
    return g.select("ai", "bj", F.exp(lp - F.lit(meta["bound"])).alias("e"))


def _arrays(g: DataFrame, meta: dict) -> DataFrame:
    """(param, lo, dx, m): marginal masses on the cells of each axis, as arrays."""
    def axis(i: str, param: str) -> DataFrame:
        m = g.groupBy(F.col(i).alias("i")).agg(F.sum("e").alias("m")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m"))
        return m.select(F.lit(param).alias("param"), F.lit(meta[f"{param}_lo"]).alias("lo"), F.lit(meta[f"{param}_dx"]).alias("dx"), "m")
    return axis("ai", "alpha").unionByName(axis("bj", "beta"))


def _fit(df: DataFrame) -> tuple[DataFrame, dict]:
    """Marginals of alpha and beta, (param, lo, dx, m, mean, sd, cdf), and what the grid was made of."""
    df = df.select("duration", "observed")
    stats, lo, hi = locate(df)
    log_s = log_power_sum(df, stats, lo, hi)
    r, L, log_c = stats["r"], stats["sum_log_t_obs"] or 0.0, math.log(stats["max_t"])
    tries = [lo + (i + 0.5) * (hi - lo) / 600 for i in range(600)]
    lms = [_laplace(a, math.exp(log_s(a)), r, L, log_c) for a in tries]
    k0, k1 = _heavy(tries, lms)
    lo, hi = max(lo, tries[k0] - (hi - lo) / 600), min(hi, tries[k1] + (hi - lo) / 600)
    dx = (hi - lo) / FINAL
    alphas = [lo + (k + 0.5) * dx for k in range(FINAL)]
    zs = [math.exp(log_s(a)) for a in alphas]
    b_lo, b_hi = beta_range(alphas, zs, r, L, log_c)
    meta = dict(stats, L=L, log_c=log_c, bound=0.0, log_s=log_s, alpha_lo=lo, alpha_dx=dx, beta_lo=b_lo, beta_dx=(b_hi - b_lo) / FINAL,
                alphas=alphas, zs=zs, betas=(b_lo, b_hi, FINAL))
    # the density at the joint mode over the alphas, a normaliser without a global maximum
    meta["bound"] = max(r * math.log(a) + (a - 1) * L - a * a / (2 * ALPHA_SIGMA ** 2) + g - s for a, (s, _, g) in
                        ((a, _cond_log_beta(a, z, r, log_c)) for a, z in zip(alphas, zs)))
    x = lambda i: F.col("lo") + (i + F.lit(0.5)) * F.col("dx")
    rows = reliable_checkpoint(_arrays(_grid(df.sparkSession, alphas, zs, meta["betas"], meta), meta))
    every = total(F.col("m"))
    rows = rows.withColumn("mean", total(F.transform("m", lambda m, i: m * x(i))) / every).withColumn("cdf", edge_cdf(F.col("m")))
    rows = reliable_checkpoint(rows.withColumn("mass", every))
    sd = F.sqrt(total(F.transform("m", lambda m, i: m * (x(i) - F.col("mean")) * (x(i) - F.col("mean")))) / F.col("mass"))
    return reliable_checkpoint(rows.withColumn("sd", sd)), meta


def _at(position: Column) -> Column:
    return F.col("lo") + position * F.col("dx")


def weibull_posterior(df: DataFrame) -> DataFrame:
    """Posterior summaries of alpha and beta (op P5)."""
    rows, meta = _fit(df)
    hdi = narrowest(F.col("m"), F.col("cdf"))
    return rows.select("param", F.lit(int(meta["n"])).cast("long").alias("n"), F.lit(int(meta["r"])).cast("long").alias("r"),
                       "mean", "sd", _at(quantile_at(F.col("cdf"), F.lit(0.5))).alias("median"), F.transform(hdi, _at).alias("h")) \
        .select("param", "n", "r", "mean", "sd", "median", F.col("h")[0].alias("hdi_3"), F.col("h")[1].alias("hdi_97"))


def weibull_curves(df: DataFrame, points: int = CURVE_N) -> DataFrame:
    """Marginal posterior densities of alpha and beta at ``points`` x over mean +- 6 sd (P7 for P5).

    Each is summed over the other parameter's grid at the points themselves."""
    rows, meta = _fit(df)
    out = None
    for r in rows.select("param", "mean", "sd", "mass", "dx").collect():      # two rows
        dx = 12 * r["sd"] / points
        lo = max(r["mean"] - 6 * r["sd"], 1e-9)
        if r["param"] == "alpha":
            alphas = [lo + (k + 0.5) * dx for k in range(points)]
            g, i = _grid(df.sparkSession, alphas, [math.exp(meta["log_s"](a)) for a in alphas], meta["betas"], meta), "ai"
            step = meta["alpha_dx"]
        else:
            g, i = _grid(df.sparkSession, meta["alphas"], meta["zs"], (lo, lo + 12 * r["sd"], points), meta), "bj"
            step = meta["beta_dx"]
        one = g.groupBy(F.col(i).alias("i")).agg(F.sum("e").alias("f")).select(
            F.lit(r["param"]).alias("param"), "i", (F.lit(lo) + (F.col("i") + F.lit(0.5)) * F.lit(dx)).alias("x"),
            (F.col("f") / F.lit(r["mass"] * step)).alias("y"))
        out = one if out is None else out.unionByName(one)
    return out


def weibull_traces_from(df: DataFrame, n_traces: int = 30, seed: int = 0) -> DataFrame:
    """Sampled Weibull pdf traces and the constant-hazard reference (V5, V6).

    alpha and beta are drawn independently from their marginals (as the
    reference UI does), by inverse CDF on the marginal cells.
    """
    from bayes_ops.operators.draws import uniforms
    from bayes_ops.operators.views import weibull_traces
    rows, _ = _fit(df)
    u = uniforms(rows, ["param"], n_traces, seed).join(rows.select("param", "lo", "dx", "cdf"), "param")
    d = reliable_checkpoint(u.select("param", "draw_id", _at(quantile_at(F.col("cdf"), F.col("u"))).alias("value")))
    a = d.where(F.col("param") == "alpha").select("draw_id", "value")
    b = d.where(F.col("param") == "beta").select("draw_id", "value")
    return weibull_traces(a, b)
