"""Bernoulli success probability (op P1): Beta(1 + s, 1 + n - s)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayes_ops.operators.grid import conjugate_curve, conjugate_summary
from bayes_ops.operators.suffstats import bernoulli_stats


def bernoulli_params(df: DataFrame, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    a0, b0 = prior
    return (bernoulli_stats(df)
            .withColumn("param", F.lit("p"))
            .withColumn("alpha", F.lit(float(a0)) + F.col("successes").cast("double"))
            .withColumn("beta", F.lit(float(b0)) + (F.col("trials") - F.col("successes")).cast("double")))


def bernoulli_posterior(df: DataFrame, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    out = conjugate_summary(bernoulli_params(df, prior), ["param"], "beta")
    return out.select("param", "successes", "trials", "n_dropped", "alpha", "beta",
                      "mean", "sd", "median", "hdi_3", "hdi_97")


def bernoulli_curve(df: DataFrame, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    return conjugate_curve(bernoulli_params(df, prior), ["param"], "beta")
