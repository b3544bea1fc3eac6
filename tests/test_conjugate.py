"""Closed forms and grid summaries on hand-built tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayes_ops.operators.grid import conjugate_curve, conjugate_summary
from bayes_ops.plans.bernoulli import bernoulli_posterior
from bayes_ops.plans.poisson import poisson_posterior, window_exposure


def test_bernoulli_closed_form(spark):
    # s = 37 successes out of n = 99 -> Beta(38, 63)
    rows = [(None, i < 37) for i in range(99)]
    df = spark.createDataFrame(rows, "timestamp timestamp, outcome boolean")
    r = bernoulli_posterior(df).first()
    assert (r.successes, r.trials, r.alpha, r.beta) == (37, 99, 38.0, 63.0)
    assert r.mean == pytest.approx(38 / 101, abs=1e-12)
    assert r.sd == pytest.approx(math.sqrt(38 * 63 / (101 ** 2 * 102)), abs=1e-12)
    draws = np.random.default_rng(0).beta(38, 63, 2_000_000)
    assert r.median == pytest.approx(np.median(draws), abs=2e-4)
    assert r.hdi_3 < r.median < r.hdi_97
    # 94 % mass inside the HDI, and it is narrower than the central interval
    inside = ((draws >= r.hdi_3) & (draws <= r.hdi_97)).mean()
    assert inside == pytest.approx(0.94, abs=2e-3)
    lo, hi = np.quantile(draws, [0.03, 0.97])
    assert r.hdi_97 - r.hdi_3 <= hi - lo + 1e-3


def test_bernoulli_nulls_counted(spark):
    df = spark.createDataFrame([(None, True), (None, None), (None, False)], "timestamp timestamp, outcome boolean")
    r = bernoulli_posterior(df).first()
    assert (r.successes, r.trials, r.n_dropped) == (1, 2, 1)


def test_gamma_zero_events_hdi(spark):
    # k = 0, E = 30 -> Gamma(1, 31): HDI = [0, -ln(0.06)/31]
    params = spark.createDataFrame([("g", 1.0, 31.0)], "g string, alpha double, beta double")
    r = conjugate_summary(params, ["g"], "gamma").first()
    assert r.hdi_3 == pytest.approx(0.0, abs=1e-9)
    assert r.hdi_97 == pytest.approx(-math.log(0.06) / 31, rel=2e-3)
    assert r.median == pytest.approx(math.log(2) / 31, rel=1e-4)


def test_curve_integrates_to_one(spark):
    params = spark.createDataFrame([("a", 40.0, 3.0), ("b", 2.0, 0.5)], "g string, alpha double, beta double")
    cur = conjugate_curve(params, ["g"], "gamma").toPandas()
    shapes = {"a": (40.0, 3.0), "b": (2.0, 0.5)}
    for g, part in cur.groupby("g"):
        part = part.sort_values("x")
        dx = part.x.diff().median()
        a, b = shapes[g]
        # exact Gamma mass inside the plotted window, by fine quadrature
        lo, hi = part.x.min() - dx / 2, part.x.max() + dx / 2
        xs = np.linspace(lo, hi, 400001)
        pdf = np.exp((a - 1) * np.log(np.maximum(xs, 1e-300)) - b * xs + a * math.log(b) - math.lgamma(a))
        mass = np.trapezoid(pdf, xs)
        assert (part.y * dx).sum() == pytest.approx(mass, abs=5e-4)  # 200-point Riemann sum
        # and the density matches the exact pdf at the points
        y_exact = np.exp((a - 1) * np.log(part.x) - b * part.x + a * math.log(b) - math.lgamma(a))
        assert np.allclose(part.y, y_exact, rtol=1e-4)  # normalised by the 2000-cell grid integral


def test_poisson_exposure_units():
    assert window_exposure("2024-01-01", "2024-01-31") == 30.0
    assert window_exposure("2024-01-01", "2024-01-02", unit="hour", population=2) == 48.0
    with pytest.raises(ValueError):
        window_exposure("2024-01-01", "2024-01-02", unit="week")


def test_poisson_groups_and_validation(spark):
    rows = [("2024-01-01 01:00:00", "a", "x"), ("2024-01-01 02:00:00", "a", "y"),
            ("2024-01-02 00:00:00", "b", "x"), ("2024-01-05 00:00:00", "b", "x")]
    df = (spark.createDataFrame(rows, "ts string, cohort string, event_type string")
          .select(F.col("ts").cast("timestamp").alias("timestamp"), "cohort", "event_type"))
    out = {r.group_key: r for r in poisson_posterior(df, "2024-01-01", "2024-01-03",
                                                      group_by=["cohort", "event_type"]).collect()}
    assert set(out) == {"a:x", "a:y", "b:x"}            # window is half-open, b's 01-05 event is out
    assert out["b:x"].alpha == 2.0 and out["b:x"].beta == 3.0  # Gamma(1 + 1, 1 + 2 days)
    with pytest.raises(ValueError):
        poisson_posterior(df, "2024-01-01", "2024-01-03", group_by=["user"])


def test_poisson_explicit_groups_keep_zero(spark):
    df = spark.createDataFrame([], "timestamp timestamp, cohort string, event_type string")
    groups = spark.createDataFrame([("a",), ("b",)], "cohort string")
    out = poisson_posterior(df, "2024-01-01", "2024-01-02", groups=groups).collect()
    assert sorted((r.cohort, r.n_events, r.alpha) for r in out) == [("a", 0, 1.0), ("b", 0, 1.0)]


@pytest.mark.parametrize("family,a,b", [("gamma", 1.0, 31.0), ("gamma", 1.5, 1.0), ("gamma", 2.9, 0.2),
                                        ("beta", 51.0, 1.0), ("beta", 1.2, 2.5), ("beta", 40.0, 70.0)])
def test_small_shape_grid_matches_sql_mirror(spark, family, a, b):
    """The transformed grids (u^2 for Gamma, cosine for Beta) give the same
    numbers in Spark and in the DuckDB SQL used as the oracle, and the
    median is close to the exact one."""
    import duckdb
    from bayes_ops.sqlcheck import conjugate_summary_ctes
    params = spark.createDataFrame([("g", "p", a, b)], "g string, param string, alpha double, beta double")
    r = conjugate_summary(params, ["g", "param"], family).first()
    sql = (f"WITH params AS (SELECT 'g' AS g, 'p' AS param, CAST({a} AS DOUBLE) AS alpha, "
           f"CAST({b} AS DOUBLE) AS beta),\n{conjugate_summary_ctes('params', ['g', 'param'], family)}\n"
           "SELECT median, hdi_3, hdi_97 FROM cs")
    m, lo, hi = duckdb.sql(sql).fetchall()[0]
    assert (r.median, r.hdi_3, r.hdi_97) == pytest.approx((m, lo, hi), rel=1e-12, abs=1e-15)
    rng = np.random.default_rng(0)
    draws = rng.gamma(a, 1 / b, 4_000_000) if family == "gamma" else rng.beta(a, b, 4_000_000)
    assert r.median == pytest.approx(np.median(draws), abs=3e-3 * r.sd)
    inside = ((draws >= r.hdi_3) & (draws <= r.hdi_97)).mean()
    assert inside == pytest.approx(0.94, abs=1e-3)
