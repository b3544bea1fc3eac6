"""Sufficient statistics: one distributed aggregation per model.

Every aggregate here is algebraic (sum, count, max): Spark runs a partial
aggregate in each map task before the shuffle, so a group that holds a
third of all rows still sends one partial row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayes_ops.operators.filters import observed_flag, positive


def bernoulli_stats(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """successes, trials (NULL outcomes counted in n_dropped) (ops A1/A2)."""
    out = F.col("outcome").cast("long")
    aggs = [
        F.sum(F.when(out.isNotNull(), out).otherwise(F.lit(0))).cast("long").alias("successes"),
        F.count(out).alias("trials"),
        F.sum(F.when(out.isNull(), 1).otherwise(0)).cast("long").alias("n_dropped"),
    ]
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(*aggs)


def ab_stats(df: DataFrame) -> DataFrame:
    """Per variant: successes, trials, failures (op A2)."""
    return (bernoulli_stats(df, ["variant"])
            .where(F.col("variant").isNotNull())
            .withColumn("failures", F.col("trials") - F.col("successes")))


def reward_histogram(df: DataFrame) -> DataFrame:
    """(arm, reward) -> count.  Additive, so appendable and streamable."""
    return (df.where(F.col("arm").isNotNull() & F.col("reward").isNotNull())
            .groupBy("arm", "reward").agg(F.count(F.lit(1)).alias("cnt")))


def bandit_stats_from_histogram(hist: DataFrame) -> DataFrame:
    """Per arm: pulls, magnitude = max positive reward, successes = pulls
    paying exactly the magnitude, failures (ops A3, A4, J2).

    One aggregation over the (arm, reward) histogram: the count at the
    largest positive reward is ``max_by(cnt, reward)`` (NULL orderings, i.e.
    non-positive rewards, are skipped).  Algebraic, so a hot arm is reduced
    map-side even when rewards are continuous and the histogram is large.
    """
    pos = F.when(positive("reward"), F.col("reward"))
    return (hist.groupBy("arm").agg(
        F.sum("cnt").cast("long").alias("pulls"),
        F.max(pos).alias("magnitude"),
        F.coalesce(F.max_by("cnt", pos), F.lit(0)).cast("long").alias("successes"))
        .withColumn("failures", F.col("pulls") - F.col("successes")))


def bandit_stats(df: DataFrame) -> DataFrame:
    return bandit_stats_from_histogram(reward_histogram(df))


def arm_magnitudes(df: DataFrame) -> DataFrame:
    """Arm -> max positive reward (op A3); arms that never pay are absent."""
    return (df.where(positive("reward")).groupBy("arm")
            .agg(F.max("reward").alias("magnitude")))


POISSON_GROUPS = ("cohort", "event_type")


def validate_group_by(group_by: Sequence[str]) -> list[str]:
    gb = list(group_by)
    if not gb or not all(c in POISSON_GROUPS for c in gb):
        raise ValueError(f"group_by takes one or more of {', '.join(POISSON_GROUPS)}, not {gb}")
    return gb


def event_counts(df: DataFrame, group_by: Sequence[str], exposure_col: str | None = None) -> DataFrame:
    """k per group (op A5) and, when asked, summed exposure (op A6, quirk Q4)."""
    aggs = [F.count(F.lit(1)).alias("n_events")]
    if exposure_col:
        aggs.append(F.sum(F.col(exposure_col)).cast("double").alias("exposure"))
    return df.groupBy(*group_by).agg(*aggs)


def event_counts_all_groupings(df: DataFrame) -> DataFrame:
    """k for (cohort), (event_type) and (cohort, event_type) in one scan
    (GROUPING SETS, op A5); ``grouping_id`` tells which key is rolled up
    (1: event_type rolled up, 2: cohort rolled up, 0: both kept)."""
    return (df.groupingSets([["cohort"], ["event_type"], ["cohort", "event_type"]],
                            "cohort", "event_type")
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.grouping_id().alias("grouping_id")))


def power_sums(df: DataFrame, alphas: Sequence[float], scale: float,
               prefix: str = "s", with_basic: bool = False) -> DataFrame:
    """S(alpha_i) = sum over all rows of (t/scale)^alpha_i, one scan (op A7).

    ``ln(t/scale)`` is projected once per row and each node adds one
    ``exp``; one aggregate per node, all computed map-side, so the shuffle
    carries one partial row per task.  ``scale`` keeps the powers away from
    overflow; t = 0 contributes 0 (log is NULL, skipped by sum).
    ``with_basic`` adds n, r, sum_log_t_obs, max_t, min_t to the same scan.
    """
    t = F.col("duration")
    valid = df.where(t.isNotNull() & F.col("observed").isNotNull())
    lt = valid.select(F.log(t / F.lit(float(scale))).alias("lt"), t.alias("t"), F.col("observed").alias("o"))
    aggs = [F.sum(F.exp(F.lit(float(a)) * F.col("lt"))).alias(f"{prefix}{i}") for i, a in enumerate(alphas)]
    if with_basic:
        aggs += [F.count(F.lit(1)).alias("n"),
                 F.sum(F.when(F.col("o"), 1).otherwise(0)).cast("long").alias("r"),
                 F.sum(F.when(F.col("o"), F.log("t"))).alias("sum_log_t_obs"),
                 F.max("t").alias("max_t"), F.min("t").alias("min_t")]
    return lt.agg(*aggs)


def time_extent(df: DataFrame, col: str = "timestamp", with_count: bool = False) -> DataFrame:
    """Observed min/max of a column (op A12), optionally with the row count."""
    aggs = [F.min(col).alias("min_value"), F.max(col).alias("max_value")]
    if with_count:
        aggs.append(F.count(F.lit(1)).alias("n"))
    return df.agg(*aggs)


def row_count(df: DataFrame) -> DataFrame:
    """Total row count as a one-row frame (ops A10, A11)."""
    return df.agg(F.count(F.lit(1)).alias("total_count"))


def pull_outcomes(df: DataFrame) -> DataFrame:
    """Each pull labelled success when its reward equals the arm's magnitude
    (op J2, the row-level form of A4).  The per-arm magnitude table is joined
    by a plain equi-join: AQE broadcasts it when small (one row per arm)."""
    mags = arm_magnitudes(df)
    return (df.join(mags, "arm", "left")
            .withColumn("outcome", F.coalesce(F.col("reward") == F.col("magnitude"), F.lit(False)).cast("long")))
