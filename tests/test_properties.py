"""Property tests (Hypothesis) and plan-shape checks."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bayes_ops.operators.compare import prob_greater
from bayes_ops.operators.grid import conjugate_summary, family_support, grid_posterior
from bayes_ops.operators.suffstats import bernoulli_stats

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(a=st.floats(0.6, 5000.0), b=st.floats(0.6, 5000.0), fam=st.sampled_from(["beta", "gamma"]))
def test_grid_weights_and_cdf(spark, a, b, fam):
    params = spark.createDataFrame([("g", a, b)], "g string, alpha double, beta double")
    lo, hi, logp, t = family_support(fam, F.col("alpha"), F.col("beta"))
    g = grid_posterior(params, ["g"], lo, hi, logp, 500, t).select("i", "w", "cdf").toPandas().sort_values("i")
    assert g.w.sum() == pytest.approx(1.0, abs=1e-9)
    assert (np.diff(g.cdf.to_numpy()) >= -1e-15).all() and g.cdf.iloc[-1] == pytest.approx(1.0, abs=1e-9)
    s = conjugate_summary(params, ["g"], fam, n=500).first()
    assert s.hdi_3 <= s.median <= s.hdi_97


@SETTINGS
@given(a1=st.floats(2.0, 400.0), a2=st.floats(2.0, 400.0), b1=st.floats(0.5, 20.0), b2=st.floats(0.5, 20.0))
def test_prob_greater_complements(spark, a1, a2, b1, b2):
    params = spark.createDataFrame([("x", a1, b1), ("y", a2, b2)], "g string, alpha double, beta double")
    pairs = spark.createDataFrame([("x", "y"), ("y", "x")], "group_a string, group_b string")
    p = {(r.group_a, r.group_b): r.p_a_gt_b for r in prob_greater(params, "g", pairs).collect()}
    assert p[("x", "y")] + p[("y", "x")] == pytest.approx(1.0, abs=1e-4)


@SETTINGS
@given(arms=st.lists(st.tuples(st.integers(0, 60), st.integers(1, 60), st.sampled_from([1.0, 2.5, 5.0])),
                     min_size=2, max_size=5))
def test_prob_best_is_a_distribution(spark, arms):
    from bayes_ops.plans.bandit import prob_best
    rows = [(f"arm{i}", float(1 + min(s, n)), float(1 + n - min(s, n)), m if min(s, n) > 0 else None)
            for i, (s, n, m) in enumerate(arms)]
    params = spark.createDataFrame(rows, "arm string, alpha double, beta double, magnitude double")
    pb = [r.prob_best for r in prob_best(params).collect()]
    assert len(pb) == len(arms)
    assert sum(pb) == pytest.approx(1.0, abs=1e-6) and min(pb) >= 0.0


@SETTINGS
@given(outcomes=st.lists(st.booleans(), min_size=1, max_size=200), cut=st.integers(0, 200),
       parts=st.integers(1, 7))
def test_append_then_fit_equals_fit_of_union(spark, outcomes, cut, parts):
    rows = [(o,) for o in outcomes]
    cut = min(cut, len(rows))
    a = spark.createDataFrame(rows[:cut] or [(None,)], "outcome boolean").where(F.lit(cut > 0))
    b = spark.createDataFrame(rows[cut:] or [(None,)], "outcome boolean").where(F.lit(cut < len(rows)))
    union = a.unionByName(b).repartition(parts)
    s = bernoulli_stats(union).first()
    s1, s2 = bernoulli_stats(a).first(), bernoulli_stats(b).first()
    assert s.successes == (s1.successes or 0) + (s2.successes or 0) == sum(outcomes)
    assert s.trials == s1.trials + s2.trials == len(outcomes)


def test_row_order_and_partitioning_do_not_matter(spark):
    from bayes_ops.plans.poisson import poisson_posterior
    from bayes_ops.sources import adapters as AD
    from tests.conftest import SF001
    ev = AD.poisson_from_events(spark, SF001)
    a = poisson_posterior(ev, "2024-01-01", "2024-01-31").orderBy("cohort").collect()
    b = poisson_posterior(ev.repartition(5).orderBy(F.rand(3)), "2024-01-01", "2024-01-31").orderBy("cohort").collect()
    assert a == b


def test_hot_key_is_reduced_map_side(spark, capsys):
    """A cohort holding a third of all rows: the aggregation is partial before
    the shuffle, so the hot key sends one row per task (and results are whole)."""
    from bayes_ops.operators.suffstats import event_counts
    n = 30000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot"))
                               .otherwise(F.concat(F.lit("c"), (F.col("id") % 1000).cast("string"))).alias("cohort"))
    out = event_counts(df.repartition(6), ["cohort"])
    out.explain(mode="formatted")
    plan = capsys.readouterr().out
    import re
    # formatted plans number operators bottom-up: the partial aggregate must
    # come before (below) the hash exchange on the group key
    blocks = re.split(r"\n(?=\(\d+\) )", plan)
    partial = [int(re.match(r"\((\d+)\)", b).group(1)) for b in blocks
               if re.match(r"\(\d+\) HashAggregate", b) and "partial_count" in b]
    shuffle = [int(re.match(r"\((\d+)\)", b).group(1)) for b in blocks
               if re.match(r"\(\d+\) Exchange", b) and "hashpartitioning(cohort" in b]
    assert partial and shuffle and min(partial) < min(shuffle)
    got = {r.cohort: r.n_events for r in out.collect()}
    assert got["hot"] == n // 3 and sum(got.values()) == n


def test_trial_sequence_splits_hot_group(spark):
    """N7 numbering with a variant holding a third of the rows spread over
    several range partitions equals a single-window numbering."""
    from pyspark.sql import Window
    from bayes_ops.operators.listing import trial_sequence
    n = 6000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), (F.col("id") % 7).cast("string")))
        .alias("variant"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 100003).alias("timestamp"),
        ((F.col("id") * 31) % 5 == 0).cast("long").alias("outcome"))
    got = trial_sequence(df)
    parts = got.where(F.col("variant") == "hot").select(F.spark_partition_id()).distinct().count()
    w = Window.partitionBy("variant").orderBy("timestamp", "outcome")
    want = (df.withColumn("seq", F.row_number().over(w))
            .withColumn("cum_successes", F.sum("outcome").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    cols = ["variant", "seq", "timestamp", "outcome", "cum_successes"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert parts >= 1


@SETTINGS
@given(vals=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=300),
       probs=st.lists(st.floats(0.0, 1.0), min_size=1, max_size=6), parts=st.integers(1, 6))
def test_exact_percentiles_match_numpy(spark, vals, probs, parts):
    from bayes_ops.operators.quantiles import exact_percentiles
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(parts)
    got = exact_percentiles(df, "x", probs)
    want = np.percentile(np.array(vals), [p * 100 for p in probs])
    assert np.allclose(got, want, rtol=1e-12, atol=1e-9)


@SETTINGS
@given(a=st.floats(1.0, 3000.0), b=st.floats(1.0, 3000.0), fam=st.sampled_from(["beta", "gamma"]))
def test_grid_convergence(spark, a, b, fam):
    """Doubling the grid moves the median by < 1e-5 sd, small shapes included
    (transformed grids), and each HDI edge by at most one cell (the edge on
    the side of the last, partly included cell is interpolated; the other
    is a cell edge).  The widest cell is 2 x 40 sd / n (u^2 grid)."""
    params = spark.createDataFrame([("g", a, b)], "g string, alpha double, beta double")
    r1 = conjugate_summary(params, ["g"], fam, n=2000).first()
    r2 = conjugate_summary(params, ["g"], fam, n=4000).first()
    assert abs(r1.median - r2.median) < 1e-5 * r1.sd
    cell = 2.0 * 40.0 * r1.sd / 2000
    assert abs(r1.hdi_3 - r2.hdi_3) <= cell and abs(r1.hdi_97 - r2.hdi_97) <= cell
