"""Power sums as a function: two scans, agreement with direct sums, ranges beyond the ladder."""

import math

import numpy as np
import pytest

from bayes_ops.plans import weibull as W


def _frame(spark, t, observed=True):
    return spark.createDataFrame([(float(x), observed) for x in t], "duration double, observed boolean")


@pytest.mark.parametrize("case", ["spread", "narrow", "one", "days"])
def test_log_power_sum_agrees_with_direct_sums(spark, case):
    rng = np.random.default_rng(4)
    t = {"spread": np.exp(rng.normal(0, 2.5, 4000)), "narrow": 7 + 0.01 * rng.random(3000),
         "one": np.full(50, 3.0), "days": rng.weibull(0.7, 500) * 1e9}[case]
    df = _frame(spark, t)
    stats, lo, hi = W.locate(df)
    s = W.log_power_sum(df, stats, lo, hi)
    for a in np.linspace(lo, hi, 37):
        want = math.log(np.sum(np.exp(a * np.log(t / t.max()))))
        assert s(float(a)) == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_two_scans(spark, monkeypatch):
    """One aggregation with the ladder, one with the Chebyshev nodes."""
    scans = []
    real = W.power_sums
    monkeypatch.setattr(W, "power_sums", lambda *a, **k: scans.append(len(a[1])) or real(*a, **k))
    df = _frame(spark, np.random.default_rng(5).weibull(1.7, 3000) * 40)
    got = {r["param"]: r for r in W.weibull_posterior(df).collect()}
    assert len(scans) == 2 and scans[0] == len(W.LADDER)
    assert got["alpha"]["mean"] == pytest.approx(1.7, abs=0.1)


def test_nothing_observed(spark):
    """Only censored rows: the prior of alpha, tilted towards long survival, still ends."""
    got = {r["param"]: r for r in W.weibull_posterior(_frame(spark, [1.0, 2.0, 5.0], False)).collect()}
    assert 0 < got["alpha"]["mean"] < 3 and got["beta"]["mean"] > 5 and got["alpha"]["r"] == 0


def test_shape_beyond_the_ladder(spark):
    """Durations within one part in a thousand: the shape is far over 64, the prior holds it back."""
    t = 5.0 * (1 + 1e-4 * np.random.default_rng(6).standard_normal(3000))
    stats, lo, hi = W.locate(_frame(spark, t))
    assert lo < hi and hi > 20


def test_empty_table_is_an_error(spark):
    with pytest.raises(ValueError):
        W.weibull_posterior(_frame(spark, [])).collect()
