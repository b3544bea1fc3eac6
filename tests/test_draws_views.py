"""Draws, HDI from draws, pairwise comparison, KDE and timeline density."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayes_ops.operators.compare import prob_greater
from bayes_ops.operators.draws import hdi_from_draws, posterior_draws, quantile_band


def test_draws_reproducible_and_distributed(spark):
    params = spark.createDataFrame([("a", 50.0, 10.0), ("b", 5.0, 2.0)], "g string, alpha double, beta double")
    d1 = posterior_draws(params, ["g"], "gamma", n=4000, seed=9).toPandas()
    d2 = posterior_draws(params.repartition(3), ["g"], "gamma", n=4000, seed=9).toPandas()
    key = ["g", "draw_id"]
    m = d1.merge(d2, on=key)
    assert len(m) == 8000 and np.allclose(m.value_x, m.value_y)
    a = d1[d1.g == "a"].value
    assert a.mean() == pytest.approx(5.0, abs=0.03)
    assert a.std() == pytest.approx(np.sqrt(50) / 10, rel=0.05)


def test_hdi_from_draws_matches_numpy(spark):
    rng = np.random.default_rng(2)
    vals = rng.gamma(3.0, 1.0, 1001)
    df = spark.createDataFrame([("g", int(i), float(v)) for i, v in enumerate(vals)], "g string, draw_id long, value double")
    r = hdi_from_draws(df, ["g"]).first()
    s = np.sort(vals)
    k = int(np.floor(0.94 * len(s)))
    w = s[k:] - s[:len(s) - k]
    i = int(np.argmin(w))
    assert (r.hdi_low, r.hdi_high) == (s[i], s[i + k])
    q = quantile_band(df, ["g"]).first()
    assert q.q_25 == s[int(np.floor(0.025 * 1000))] and q.q_975 == s[int(np.floor(0.975 * 1000))]


def test_prob_greater_symmetry(spark):
    params = spark.createDataFrame([("a", 120.0, 10.0), ("b", 100.0, 10.0)], "g string, alpha double, beta double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "group_a string, group_b string")
    out = {(r.group_a, r.group_b): r.p_a_gt_b for r in prob_greater(params, "g", pairs).collect()}
    assert out[("a", "b")] + out[("b", "a")] == pytest.approx(1.0, abs=1e-6)
    rng = np.random.default_rng(0)
    mc = (rng.gamma(120, 0.1, 1_000_000) > rng.gamma(100, 0.1, 1_000_000)).mean()
    assert out[("a", "b")] == pytest.approx(mc, abs=2e-3)


@pytest.mark.parametrize("outlier", [None, 1e6])
def test_kde_equals_the_kernel_sum(spark, outlier):
    from bayes_ops.operators.views import gaussian_kde
    rng = np.random.default_rng(4)
    v = rng.normal(10, 2, 3000)
    if outlier is not None:
        v = np.append(v, outlier)
    df = spark.createDataFrame([("g", float(x)) for x in v], "g string, value double")
    k = gaussian_kde(df, ["g"], "value").toPandas().sort_values("j")
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min(), v.max(), 200)
    exact = np.exp(-((x[:, None] - v[None, :]) / h) ** 2 / 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert np.allclose(k.x.to_numpy(), x)
    assert np.max(np.abs(k.y.to_numpy() - exact)) < 1e-8 * exact.max()


def test_kde_of_groups_without_spread(spark):
    from bayes_ops.operators.views import gaussian_kde
    df = spark.createDataFrame([("one", 3.0), ("same", 4.0), ("same", 4.0), (None, 1.0), (None, 2.0), ("one", None)],
                               "g string, value double")
    k = gaussian_kde(df, ["g"], "value").toPandas()
    assert k.groupby("g", dropna=False).size().tolist() == [200, 200, 200]
    assert k[k.g.notna()].y.isna().all() and (k[k.g.isna()].y > 0).all()


def test_timeline_density_exact(spark):
    from bayes_ops.operators.views import epanechnikov_timeline
    rng = np.random.default_rng(8)
    ms = np.sort(rng.integers(1_700_000_000_000, 1_700_000_000_000 + 86_400_000 * 5, 400))
    df = spark.createDataFrame([("c", int(m)) for m in ms], "cohort string, ms long").select(
        "cohort", F.timestamp_millis("ms").alias("timestamp"))
    out = epanechnikov_timeline(df, ["cohort"]).toPandas().sort_values("j")
    t = ms.astype(float)
    h = 1.06 * t.std(ddof=1) / len(t) ** 0.2
    ticks = t.min() + np.arange(200) * (t.max() - t.min()) / 199
    u = (ticks[:, None] - t[None, :]) / h
    exact = np.where(np.abs(u) <= 1, 0.75 * (1 - u * u) / h, 0).mean(1)
    assert np.allclose(out.density.to_numpy(), exact, rtol=1e-9, atol=1e-18)
