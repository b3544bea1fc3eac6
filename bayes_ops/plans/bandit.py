"""Multi-armed bandit posterior (ops P3, J1, E7, C3, C6).

A pull succeeds when its reward equals the arm's magnitude (the largest
positive reward seen on that arm); Beta(1 + successes, 1 + failures) per arm.
The expected reward of an arm is p x magnitude; an arm that never paid has
no magnitude, expected reward NULL and probability of being best 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bayes_ops.operators.grid import conjugate_summary, family_support, grid_posterior, GRID_N
from bayes_ops.operators.materialize import reliable_checkpoint
from bayes_ops.operators.suffstats import bandit_stats, bandit_stats_from_histogram

TINY = 1e-300


def bandit_params(df: DataFrame | None = None, prior: tuple[float, float] = (1.0, 1.0),
                  hist: DataFrame | None = None) -> DataFrame:
    """Per-arm Beta parameters from the pulls table, or from an already
    aggregated (arm, reward, cnt) histogram (``hist``)."""
    a0, b0 = prior
    st = bandit_stats_from_histogram(hist) if hist is not None else bandit_stats(df)
    return (st.withColumn("alpha", F.lit(float(a0)) + F.col("successes").cast("double"))
              .withColumn("beta", F.lit(float(b0)) + F.col("failures").cast("double"))
              .withColumn("est_prob", F.col("alpha") / (F.col("alpha") + F.col("beta")))
              .withColumn("expected_reward", F.col("est_prob") * F.col("magnitude")))


def bandit_posterior(df: DataFrame | None = None, hist: DataFrame | None = None) -> DataFrame:
    """Per arm: pulls, successes, failures, magnitude, alpha, beta, est_prob,
    expected_reward and the summary of p (op P3)."""
    params = bandit_params(df, hist=hist).withColumn("param", F.lit("p"))
    out = conjugate_summary(params, ["arm", "param"], "beta")
    return out.select("arm", "pulls", "successes", "failures", "magnitude", "alpha", "beta",
                      "est_prob", "expected_reward", "mean", "sd", "median", "hdi_3", "hdi_97")


def prob_best(params: DataFrame, n: int = GRID_N) -> DataFrame:
    """Exact P(arm has the highest expected reward) (op C3).

    P_i = integral of f_i(v) prod_{j != i} F_j(v) dv, v = p x magnitude.  Every
    arm brings its own breakpoints: the cells of its Beta grid, so an arm with
    1e9 pulls is as well resolved as one with two.  Between its breakpoints
    log F_j is linear, hence G = sum_j log F_j is linear between the merged
    breakpoints of all arms; it is the running sum of the arms' changes of
    slope and intercept, and its integral H(v) = int e^G is exact.  On a cell
    of arm i, f_i prod F_j = (log F_i)' e^G with a constant slope, so the cell
    contributes slope x (H(end) - H(start)): linear in arms, no pairs of arms,
    and the P_i add up to one.  Below L = max_j (lowest plausible value of arm
    j) some arm is above v almost surely, so cells are cut at L.

    The at most 2 n breakpoints per arm are dealt out by range of v, so the running sums
    of any number of arms run in as many tasks as there are ranges; each range adds the sums of the ranges
    before it (one row per range).  Arms that never paid are
    worth 0 and only win when no arm pays (then the first arm by name wins
    every draw, as an argmax with ties does).
    """
    a, b, m = F.col("alpha"), F.col("beta"), F.col("magnitude")
    lo_p, hi_p, logp, tcode = family_support("beta", a, b)
    paying = params.where(m.isNotNull() & (m > 0))
    floor = paying.agg(F.max(m * lo_p)).scalar()
    grid = grid_posterior(paying, ["arm"], lo_p, hi_p, logp, n, tcode)
    log_f = lambda mass: F.log(F.greatest(mass, F.lit(TINY)))
    cells = (grid.select("arm", (m * F.col("x_lo")).alias("v0"), (m * F.col("x_hi")).alias("v1"),
                         log_f(F.col("cdf") - F.col("w")).alias("l0"), log_f(F.col("cdf")).alias("l1"),
                         floor.alias("L"))
             .withColumn("slope", (F.col("l1") - F.col("l0")) / (F.col("v1") - F.col("v0")))
             .where((F.col("v1") > F.col("L")) & (F.col("slope") != 0)))
    # offsets from L; the intercept is the line's value at L
    start, end = F.greatest(F.col("v0") - F.col("L"), F.lit(0.0)), F.col("v1") - F.col("L")
    icept = F.col("l0") - F.col("slope") * (F.col("v0") - F.col("L"))
    turns = cells.select("arm", F.explode(F.array(
        F.struct(start.alias("s"), F.col("slope").alias("db"), icept.alias("da")),
        F.struct(end.alias("s"), (-F.col("slope")).alias("db"), (-icept).alias("da")))).alias("t")).select("arm", "t.*")
    # first level: running sums inside each range partition of s; second level: what the partitions before it hold
    turns = reliable_checkpoint(turns.repartitionByRange("s").withColumn("_pid", F.spark_partition_id()))
    parts = turns.groupBy("_pid").agg(F.sum("da").alias("da"), F.sum("db").alias("db"), F.min("s").alias("s0"))
    by_pid = Window.orderBy("_pid")                    # one row per partition
    earlier = by_pid.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_pid", F.coalesce(F.sum("da").over(earlier), F.lit(0.0)).alias("da0"),
                         F.coalesce(F.sum("db").over(earlier), F.lit(0.0)).alias("db0"), F.lead("s0").over(by_pid).alias("s_next"))
    by_s = Window.partitionBy("_pid").orderBy("s")     # running sums include all rows at the same s
    line = turns.join(parts, "_pid").select(
        "_pid", "arm", "s", "db", (F.col("da0") + F.sum("da").over(by_s)).alias("icept"),
        (F.col("db0") + F.sum("db").over(by_s)).alias("slope"),
        (F.coalesce(F.lead("s").over(by_s), F.col("s_next")) - F.col("s")).alias("ds"))
    rise = F.col("slope") * F.col("ds")
    mean = F.when(F.abs(rise) < 1e-5, F.lit(1.0) - rise / 2 + rise * rise / 6).otherwise(-F.expm1(-rise) / rise)
    area = F.exp(F.col("icept") + F.col("slope") * F.col("s") + rise) * mean * F.col("ds")
    line = reliable_checkpoint(line.select("_pid", "arm", "s", "db", area.alias("area")))
    sums = line.groupBy("_pid").agg(F.sum("area").alias("area"))
    sums = sums.select("_pid", F.coalesce(F.sum("area").over(earlier), F.lit(0.0)).alias("area0"))
    before = by_s.rowsBetween(Window.unboundedPreceding, -1)
    area_before = F.col("area0") + F.coalesce(F.sum("area").over(before), F.lit(0.0))
    won = (line.join(sums, "_pid").select("arm", "db", area_before.alias("h"))
           .groupBy("arm").agg(F.greatest(F.lit(0.0), -F.sum(F.col("db") * F.col("h"))).alias("won")))
    # Non-paying arms: 0, unless nobody pays (then the first arm takes 1).
    any_pay = F.coalesce(params.agg(F.max(m)).scalar(), F.lit(0.0)) > 0
    first_arm = params.agg(F.min("arm")).scalar()
    alone = F.when(~any_pay & (F.col("arm") == first_arm), F.lit(1.0)).otherwise(F.lit(0.0))
    return (params.select("arm").join(won, "arm", "left")
            .select("arm", F.coalesce("won", alone).alias("prob_best")))


def bandit_with_prob_best(df: DataFrame | None = None, hist: DataFrame | None = None) -> DataFrame:
    """Posterior table joined with prob_best (ops P3 + C3 + J1)."""
    # one row per arm, referenced by several branches: materialise once
    params = reliable_checkpoint(bandit_params(df, hist=hist))
    pb = prob_best(params)
    return (params.join(pb, "arm", "left")
            .select("arm", "pulls", "successes", "failures", "magnitude", "alpha", "beta",
                    "est_prob", "expected_reward", "prob_best"))


def next_arm(df: DataFrame | None = None, hist: DataFrame | None = None) -> DataFrame:
    """Arm with the highest prob_best, ties to the first arm by name."""
    t = bandit_with_prob_best(df, hist=hist)
    # an aggregate with map-side partial results, not a sort of all arms
    best = t.agg(F.min_by(F.struct(*t.columns), F.struct((-F.col("prob_best")).alias("p"), "arm")).alias("b"))
    return best.where(F.col("b").isNotNull()).select("b.*")
