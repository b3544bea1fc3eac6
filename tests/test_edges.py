"""Edge cases: empty input, zero events, all censored / observed, ties, one bin."""

import math

import numpy as np
import pytest


def _surv(spark, rows):
    return spark.createDataFrame(rows, "duration double, observed boolean")


def test_empty_poisson_window_gives_no_rows(spark):
    from bayes_ops.plans.poisson import poisson_posterior
    df = spark.createDataFrame([], "timestamp timestamp, cohort string, event_type string")
    assert poisson_posterior(df, "2024-01-01", "2024-01-02").count() == 0


def test_all_successes_beta_support_clipped(spark):
    from bayes_ops.plans.bernoulli import bernoulli_posterior
    df = spark.createDataFrame([(None, True)] * 50, "timestamp timestamp, outcome boolean")
    r = bernoulli_posterior(df).first()
    assert (r.alpha, r.beta) == (51.0, 1.0)
    assert r.hdi_97 == pytest.approx(1.0, abs=1e-9)          # mode at 1: HDI touches it
    assert r.hdi_3 == pytest.approx(0.06 ** (1 / 51), rel=2e-3)  # F(x) = x^51
    assert r.median == pytest.approx(0.5 ** (1 / 51), rel=1e-5)


def test_hazard_all_censored_and_single_bin(spark):
    from bayes_ops.plans.hazard import hazard_posterior
    df = _surv(spark, [(float(t), False) for t in range(1, 21)])
    out = hazard_posterior(df, 4).orderBy("j").collect()
    assert [r.events for r in out] == [0, 0, 0, 0]
    assert [r.lower for r in out] == [0.0, 5.0, 10.0, 15.0] and out[-1].upper == 20.0
    assert sum(r.exposure for r in out) == pytest.approx(sum(range(1, 21)))
    one = hazard_posterior(_surv(spark, [(2.0, True), (3.0, False)]), 1).collect()
    assert len(one) == 1 and one[0].events == 1 and one[0].exposure == 5.0
    assert one[0].alpha == 2.0 and one[0].beta == 6.0


def test_hazard_tied_boundaries_zero_width(spark):
    from bayes_ops.plans.hazard import compute_boundaries, hazard_posterior
    df = _surv(spark, [(5.0, True)] * 30 + [(9.0, True)] * 3)
    bounds, _ = compute_boundaries(df, 4)
    assert bounds == [5.0, 5.0, 5.0]
    out = hazard_posterior(df, 4).orderBy("j").collect()
    assert out[1].events == 0 and out[1].exposure == 0.0    # zero-width interval: prior only
    assert (out[1].alpha, out[1].beta) == (1.0, 1.0)
    assert out[0].events == 30 and out[3].events == 3


def test_weibull_all_censored_is_prior_driven(spark):
    from bayes_ops.plans.weibull import weibull_posterior
    out = {r.param: r for r in weibull_posterior(_surv(spark, [(float(t), False) for t in (1, 2, 3, 4)])).collect()}
    assert out["alpha"].r == 0
    for p in ("alpha", "beta"):
        assert math.isfinite(out[p].mean) and out[p].sd > 0


def test_weibull_empty_raises(spark):
    from bayes_ops.plans.weibull import weibull_posterior
    with pytest.raises(ValueError):
        weibull_posterior(_surv(spark, []))


def test_bandit_single_arm_and_null_rewards(spark):
    from bayes_ops.plans.bandit import bandit_with_prob_best
    rows = [(None, "A", 1.0), (None, "A", 0.0), (None, "A", None), (None, None, 1.0)]
    df = spark.createDataFrame(rows, "timestamp timestamp, arm string, reward double")
    out = bandit_with_prob_best(df).collect()
    assert len(out) == 1 and out[0].pulls == 2 and out[0].prob_best == pytest.approx(1.0)


def test_ab_zero_success_variant(spark):
    from bayes_ops.plans.ab import ab_posterior
    rows = [(None, "A", 0)] * 20 + [(None, "B", 1)] * 3 + [(None, "B", 0)] * 22
    out = {r.variant: r for r in ab_posterior(
        spark.createDataFrame(rows, "timestamp timestamp, variant string, outcome long")).collect()}
    assert 0.0 <= out["A"].hdi_3 < out["A"].mean < out["B"].mean
    assert np.isfinite([out["A"].median, out["B"].median]).all()
