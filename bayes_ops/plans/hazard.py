"""Piecewise-constant hazard rates (ops A8, A9, N1, N2, P6, P9, V4).

Boundaries are the inner percentiles of observed failure times (linear
interpolation, as numpy), or an even split of [0, max t] when there are
fewer failures than bins.  Each subject contributes d log(lambda_j) -
Lambda(t) with j = #{boundaries < t}; summed, the likelihood factorises into
per-interval (events d_j, time at risk E_j), so with a Gamma(a, b) prior the
posterior is independent Gamma(a + d_j, b + E_j) per interval.

The boundaries (num_bins - 1 numbers) are computed first and used as
literals; the interval statistics are then one aggregation over the rows
keyed by interval index, a key with at most num_bins values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bayes_ops.operators.grid import conjugate_summary


def _valid(df: DataFrame) -> DataFrame:
    return df.where(F.col("duration").isNotNull() & F.col("observed").isNotNull())


def boundaries_frame(df: DataFrame, num_bins: int = 10, accuracy: int = 100000) -> DataFrame:
    """One row: failures, max_t and the inner percentile boundaries by percentile_approx."""
    t, obs = F.col("duration"), F.col("observed")
    fracs = [k / num_bins for k in range(1, num_bins)]
    if not fracs:
        pct = F.array().cast("array<double>")
    else:
        pct = F.percentile_approx(F.when(obs, t), fracs, accuracy).cast("array<double>")
    return _valid(df).agg(F.sum(F.when(obs, 1).otherwise(0)).cast("long").alias("failures"),
                          F.max(t).alias("max_t"), pct.alias("pct"))


def compute_boundaries(df: DataFrame, num_bins: int = 10, approx: bool = False) -> tuple[list[float], float | None]:
    """(num_bins - 1 boundaries, max duration)."""
    bounds, max_t, _ = boundary_stats(df, num_bins, approx)
    return bounds, max_t


def boundary_stats(df: DataFrame, num_bins: int = 10, approx: bool = False
                   ) -> tuple[list[float], float | None, int]:
    """(num_bins - 1 boundaries, max duration, failures) (op A9).

    Exact percentiles come from ``operators.quantiles``: no task holds more
    than one range partition of the distinct values, at any size.  ``approx``
    uses percentile_approx instead.
    """
    from bayes_ops.operators.quantiles import exact_percentiles
    fracs = [k / num_bins for k in range(1, num_bins)]
    v = _valid(df)
    if approx:
        row = boundaries_frame(df, num_bins).first()
    else:
        row = v.agg(F.sum(F.when(F.col("observed"), 1).otherwise(0)).cast("long").alias("failures"),
                    F.max("duration").alias("max_t")).first()
    failures, max_t = row["failures"] or 0, row["max_t"]
    if failures < num_bins:
        top = max_t if max_t is not None else 1.0
        return [top * k / num_bins for k in range(1, num_bins)], max_t, failures
    pct = row["pct"] if approx else exact_percentiles(v.where(F.col("observed")), "duration", fracs)
    return [float(x) for x in pct], max_t, failures


def interval_index(t: Column, bounds: list[float]) -> Column:
    """#{b in bounds : t > b} (op J3) as a sum of comparisons: no join."""
    expr = F.lit(0)
    for b in bounds:
        expr = expr + F.when(t > F.lit(float(b)), 1).otherwise(0)
    return expr


def interval_stats(df: DataFrame, bounds: list[float]) -> DataFrame:
    """Per interval j: rows, events d_j, time at risk E_j, edges (ops A8, N1, N2)."""
    spark: SparkSession = df.sparkSession
    nb = len(bounds) + 1
    edges = [0.0] + [float(b) for b in bounds]
    t = F.col("duration")
    per = (_valid(df).withColumn("j", interval_index(t, bounds))
           .withColumn("e_j", F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("j") + 1))
           .groupBy("j").agg(F.count(F.lit(1)).alias("n_rows"),
                             F.sum(F.when(F.col("observed"), 1).otherwise(0)).cast("long").alias("events"),
                             F.sum(t - F.col("e_j")).alias("partial_time")))
    lengths = [edges[k + 1] - edges[k] for k in range(nb - 1)] + [0.0]
    ints = spark.range(nb).select(F.col("id").cast("int").alias("j"))
    ints = (ints.withColumn("lower", F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("j") + 1))
            .withColumn("length", F.element_at(F.array(*[F.lit(x) for x in lengths]), F.col("j") + 1)))
    s = (ints.join(per, "j", "left")
         .fillna({"n_rows": 0, "events": 0, "partial_time": 0.0}))
    # rows beyond interval j: reverse running count over the (num_bins-row) table
    beyond = Window.orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("n_beyond", F.coalesce(F.sum("n_rows").over(beyond), F.lit(0)).cast("long"))
    s = s.withColumn("exposure", F.col("partial_time") + F.col("length") * F.col("n_beyond"))
    return s


def hazard_posterior(df: DataFrame, num_bins: int = 10, prior: tuple[float, float] = (1.0, 1.0),
                     approx: bool = False) -> DataFrame:
    """Per interval j: lower, upper, mid, n_rows, events, exposure and the
    Gamma posterior summary of the hazard rate (P6, V4).

    upper of the last interval = max(max duration, max boundary), or 1.
    """
    bounds, max_t = compute_boundaries(df, num_bins, approx)
    st = interval_stats(df, bounds)
    a0, b0 = prior
    params = (st.withColumn("param", F.lit("lambda"))
              .withColumn("alpha", F.lit(float(a0)) + F.col("events").cast("double"))
              .withColumn("beta", F.lit(float(b0)) + F.col("exposure")))
    out = conjugate_summary(params, ["j", "param"], "gamma")
    cands = [v for v in [max_t] + list(bounds) if v is not None]
    uppers = [float(b) for b in bounds] + [float(max(cands)) if cands else 1.0]
    out = out.withColumn("upper", F.element_at(F.array(*[F.lit(u) for u in uppers]), F.col("j") + 1))
    out = out.withColumn("mid", (F.col("lower") + F.col("upper")) / 2)
    return out.select("j", "param", "lower", "upper", "mid", "n_rows", "events", "exposure",
                      "alpha", "beta", "mean", "sd", "median", "hdi_3", "hdi_97")


def subject_loglik(df: DataFrame, bounds: list[float], lambdas: DataFrame) -> DataFrame:
    """Per-subject piecewise-exponential log-likelihood for given rates.

    ``lambdas``: (j, lam).  The cumulative hazard of the full intervals before
    j is a running sum over that num_bins-row table (N1); it is joined to the
    rows on j (a broadcast of num_bins rows).
    """
    edges = [0.0] + [float(b) for b in bounds]
    nb = len(edges)
    lengths = [edges[k + 1] - edges[k] for k in range(nb - 1)] + [0.0]
    lam = lambdas.withColumn("length", F.element_at(F.array(*[F.lit(x) for x in lengths]), F.col("j") + 1))
    prior_rows = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    lam = lam.withColumn("H_before", F.coalesce(F.sum(F.col("lam") * F.col("length")).over(prior_rows),
                                                F.lit(0.0)))
    lam = lam.withColumn("lower", F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("j") + 1))
    rows = _valid(df).withColumn("j", interval_index(F.col("duration"), bounds))
    joined = rows.join(F.broadcast(lam.select("j", "lam", "H_before", "lower")), "j")
    d = F.col("observed").cast("double")
    return joined.withColumn(
        "loglik", d * F.log(F.col("lam")) - (F.col("H_before") + F.col("lam") * (F.col("duration") - F.col("lower"))))
