"""Kinds given by a log density: closed forms, groups, ridges, far starts, ingest and errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayes_ops import kinds
from bayes_ops.operators import adaptive
from bayes_ops.operators.adaptive import Parameter


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_one_parameter_is_the_gamma_posterior(spark):
    """Poisson rate with Gamma(1, 1) prior, a NULL group and counts from 0 to 1e9."""
    stats = spark.createDataFrame([("a", 0, 3.0), ("b", 7, 2.0), (None, 1_000_000_000, 50.0)], "g string, k long, t double")
    got = by_key(adaptive.summaries(stats, ["g"], [Parameter("rate", "positive")], lambda p: F.col("k") * F.log(p["rate"]) - (
        1.0 + F.col("t")) * p["rate"]), "g")
    for g, k, t in (("a", 0, 3.0), ("b", 7, 2.0), (None, 10**9, 50.0)):
        a, b = k + 1, t + 1
        assert got[(g,)]["mean"] == pytest.approx(a / b, rel=1e-8)
        assert got[(g,)]["sd"] == pytest.approx(math.sqrt(a) / b, rel=1e-5)
    draws = np.random.default_rng(0).gamma(8, 1 / 3, 2_000_000)
    assert got[("b",)]["median"] == pytest.approx(np.median(draws), rel=2e-3)
    assert got[("a",)]["hdi_3"] == pytest.approx(0, abs=1e-3) and got[("a",)]["hdi_97"] == pytest.approx(-math.log(0.06) / 4, rel=2e-3)


def test_unit_parameter_is_the_beta_posterior(spark):
    stats = spark.createDataFrame([(0, 5), (3, 4), (400_000, 1_000_000)], "s long, n long")
    got = by_key(adaptive.summaries(stats, ["s"], [Parameter("p", "unit")], lambda p: F.col("s") * F.log(p["p"]) + (
        F.col("n") - F.col("s")) * F.log1p(-p["p"])), "s")
    for s, n in ((0, 5), (3, 4), (400_000, 1_000_000)):
        assert got[(s,)]["mean"] == pytest.approx((s + 1) / (n + 2), rel=1e-7)
    assert got[(0,)]["median"] == pytest.approx(1 - 0.5 ** (1 / 6), abs=1e-4)


def _normal_sums(df, group_by):
    y = F.col("y")
    return df.groupBy(*group_by).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))


def _normal_logp(p):
    return -F.col("n") * F.log(p["sigma"]) - (F.col("q") - 2 * p["mu"] * F.col("s") + F.col("n") * p["mu"] * p["mu"]) / (
        2 * p["sigma"] * p["sigma"]) - F.log(p["sigma"])


def test_two_parameters_of_a_registered_kind(spark, workdir):
    """A kind known only by (schema, statistics, log density) goes through ingest, the registry and the posterior."""
    from bayes_ops.sources import registry as R
    kinds.register_density("normal-rows", [("cohort", T.StringType()), ("y", T.DoubleType())],
                           [Parameter("mu"), Parameter("sigma", "positive")], _normal_sums, _normal_logp)
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(3, 2, 12), "b": rng.normal(-40, 0.01, 400)}
    rows = [(c, str(v)) for c, vs in data.items() for v in vs]
    root = f"{workdir}/lake"
    R.create_experiment(spark, root, "n", "normal-rows", "N", spark.createDataFrame(rows, "cohort string, y string"))
    got = by_key(kinds.posterior("normal-rows", R.read_experiment(spark, root, "n", "normal-rows"), group_by=["cohort"]), "cohort", "param")
    for c, ys in data.items():
        n, s2 = len(ys), ys.var(ddof=1)      # mu: Student t with n - 1 degrees, prior 1 / sigma
        mu = got[(c, "mu")]
        assert mu["mean"] == pytest.approx(ys.mean(), abs=1e-6 * math.sqrt(s2)) and mu["median"] == pytest.approx(ys.mean(), abs=1e-3 * math.sqrt(s2))
        assert mu["sd"] == pytest.approx(math.sqrt(s2 / n * (n - 1) / (n - 3)), rel=1e-4)
        sigma = math.sqrt(s2 * (n - 1) / 2) * math.exp(math.lgamma((n - 2) / 2) - math.lgamma((n - 1) / 2))
        assert got[(c, "sigma")]["mean"] == pytest.approx(sigma, rel=1e-6)
    curve = kinds.density_curves("normal-rows", spark.createDataFrame([("a", float(y)) for y in data["a"]], "cohort string, y double")).toPandas()
    for _, part in curve.groupby("param"):
        part = part.sort_values("i")
        assert np.trapezoid(part.y, part.x) == pytest.approx(1.0, abs=1e-3)


def test_two_parameters_where_one_node_holds_all_weight(spark):
    """So many rows that every other node of the first grid has a weight of exactly zero."""
    rows = [("a", 1e3, 3.3, 1.1), ("b", 4e5, 3.3, 1.1), ("c", 4e7, -2.0, 0.3)]
    stats = spark.createDataFrame([(g, n, n * m, n * (s * s + m * m)) for g, n, m, s in rows], "g string, n double, s double, q double")
    got = by_key(adaptive.summaries(stats, ["g"], [Parameter("mu"), Parameter("sigma", "positive")], _normal_logp), "g", "param")
    for g, n, m, s in rows:
        assert got[(g, "mu")]["mean"] == pytest.approx(m, abs=1e-3 * s / math.sqrt(n))
        assert got[(g, "mu")]["sd"] == pytest.approx(s / math.sqrt(n), rel=3 / n + 1e-4)
        assert got[(g, "sigma")]["mean"] == pytest.approx(s, rel=2 / n + 1e-6)
        assert got[(g, "sigma")]["sd"] == pytest.approx(s / math.sqrt(2 * n), rel=3 / n + 1e-4)


def test_three_parameters_on_a_ridge(spark):
    """Line through points far from the origin: intercept and slope correlate at -0.9; Student t marginals."""
    rng = np.random.default_rng(2)
    x = rng.uniform(1, 4, 60)
    y = 5.0 - 2.0 * x + rng.normal(0, 0.5, 60)
    sums = {"n": 60.0, "sx": x.sum(), "sy": y.sum(), "sxx": (x * x).sum(), "sxy": (x * y).sum(), "syy": (y * y).sum()}
    stats = spark.createDataFrame([tuple(float(v) for v in sums.values())], ", ".join(f"{k} double" for k in sums))

    def logp(p):
        a, b, s = p["a"], p["b"], p["s"]
        rss = (F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + F.col("n") * a * a + 2 * a * b * F.col("sx") + b * b * F.col("sxx"))
        return -(F.col("n") + 1) * F.log(s) - rss / (2 * s * s)
    got = by_key(adaptive.summaries(stats, [], [Parameter("a"), Parameter("b"), Parameter("s", "positive")], logp, cells=96), "param")
    design = np.column_stack([np.ones(60), x])
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    cov = np.linalg.inv(design.T @ design) * rss[0] / 56     # t with 58 degrees: variance s^2 * 58 / 56
    for j, name in enumerate("ab"):
        assert got[(name,)]["mean"] == pytest.approx(beta[j], abs=1e-4)
        assert got[(name,)]["sd"] == pytest.approx(math.sqrt(cov[j, j]), rel=1e-3)


def test_errors(spark):
    stats = spark.createDataFrame([(1.0,)], "v double")
    with pytest.raises(ValueError):
        adaptive.summaries(stats, [], [], lambda p: F.lit(0.0))
    with pytest.raises(RuntimeError):   # an improper density: the range never ends
        adaptive.settle(stats, [Parameter("a")], lambda p: F.lit(0.0), max_passes=4)
    with pytest.raises(KeyError):
        kinds.posterior("no such kind", stats)


def test_pooled_rates_are_a_kind(spark):
    from bayes_ops.plans.hier_poisson import hier_poisson_posterior
    from bayes_ops.sources import adapters as AD
    from tests.conftest import SF001
    ev = AD.poisson_from_events(spark, SF001)
    a = by_key(kinds.posterior("poisson-pooled", ev, start="2024-01-01", end="2024-01-31"), "event_type", "cohort")
    assert a.keys() == by_key(hier_poisson_posterior(ev, "2024-01-01", "2024-01-31"), "event_type", "cohort").keys()
