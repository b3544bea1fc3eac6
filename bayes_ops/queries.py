"""Registered queries: one per implemented operator, each (spark, sf_dir) -> DataFrame.

Every query reads the driver tables through the adapters of
``bayes_ops.sources.adapters`` and runs over the whole table.  Doubles are
rounded to 6 decimals for the engine-to-engine comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayes_ops.sources import adapters as AD

# The Poisson window used with the events table.
EVENTS_START = "2024-01-01 00:00:00"
EVENTS_END = "2024-01-31 00:00:00"


def rounded(df: DataFrame, digits: int = 6, coarse: dict[str, int] | None = None) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name), (coarse or {}).get(f.name, digits)) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _utc(spark: SparkSession) -> SparkSession:
    """The test tables hold naive timestamps meant as UTC; casting them to
    TIMESTAMP and deriving epochs/windows must not depend on the caller's zone."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def query(name: str, **coarse: int):
    """Register a query; ``coarse`` gives digits of columns whose two quadratures agree to fewer than 6."""
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(_utc(spark), sf_dir), coarse=coarse)
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# ---------------------------------------------------------------- Poisson

@query("p4_poisson_posterior")
def p4_poisson_posterior(spark, sf_dir):
    """Gamma posterior of the daily event rate per cohort."""
    from bayes_ops.plans.poisson import poisson_posterior
    ev = AD.poisson_from_events(spark, sf_dir)
    return poisson_posterior(ev, EVENTS_START, EVENTS_END, group_by=["cohort"])


# ---------------------------------------------------------------- Bernoulli / bandit

@query("p1_bernoulli_posterior")
def p1_bernoulli_posterior(spark, sf_dir):
    """Beta posterior of the purchase probability of an event."""
    from bayes_ops.plans.bernoulli import bernoulli_posterior
    return bernoulli_posterior(AD.bernoulli_from_events(spark, sf_dir))


@query("p1_bernoulli_labels_posterior")
def p1_bernoulli_labels_posterior(spark, sf_dir):
    """Beta posterior of labels.quality = 1 (P1 on a second table)."""
    from bayes_ops.plans.bernoulli import bernoulli_posterior
    return bernoulli_posterior(AD.bernoulli_from_labels(spark, sf_dir))


@query("p3_bandit_posterior")
def p3_bandit_posterior(spark, sf_dir):
    """Per-arm Beta posterior, magnitude, est_prob, expected_reward."""
    from bayes_ops.plans.bandit import bandit_posterior
    return bandit_posterior(hist=AD.bandit_histogram_from_lineitem(spark, sf_dir))


@query("c3_bandit_prob_best")
def c3_bandit_prob_best(spark, sf_dir):
    """Exact probability that each arm has the highest expected reward."""
    from bayes_ops.plans.bandit import bandit_with_prob_best
    return bandit_with_prob_best(hist=AD.bandit_histogram_from_lineitem(spark, sf_dir))


@query("c6_next_arm")
def c6_next_arm(spark, sf_dir):
    """Recommended next arm: top prob_best, ties to the first arm."""
    from bayes_ops.plans.bandit import next_arm
    return next_arm(hist=AD.bandit_histogram_from_lineitem(spark, sf_dir))


# ---------------------------------------------------------------- hazard

@query("a9_hazard_boundaries")
def a9_hazard_boundaries(spark, sf_dir):
    """Failures, max duration and inner-percentile boundaries."""
    from bayes_ops.plans.hazard import compute_boundaries
    df = AD.survival_from_lineitem(spark, sf_dir)
    bounds, max_t = compute_boundaries(df, 10)  # distributed exact percentiles
    failures = df.where(F.col("observed")).count()
    return spark.createDataFrame([(failures, max_t, k, b) for k, b in enumerate(bounds)],
                                 "failures long, max_t double, k int, boundary double")


@query("a8_hazard_suffstats")
def a8_hazard_suffstats(spark, sf_dir):
    """Per-interval events and time at risk."""
    from bayes_ops.plans.hazard import compute_boundaries, interval_stats
    df = AD.survival_from_lineitem(spark, sf_dir)
    bounds, _ = compute_boundaries(df, 10)
    return interval_stats(df, bounds).select("j", "lower", "length", "n_rows", "events", "n_beyond", "exposure")


@query("p6_hazard_posterior")
def p6_hazard_posterior(spark, sf_dir):
    """Gamma posterior of each piecewise hazard rate with band edges."""
    from bayes_ops.plans.hazard import hazard_posterior
    return hazard_posterior(AD.survival_from_lineitem(spark, sf_dir), 10)


@query("p9_hazard_loglik")
def p9_hazard_loglik(spark, sf_dir):
    """Piecewise-exponential log-likelihood at the posterior-mean rates,
    summed per interval (P9, N1)."""
    from bayes_ops.plans.hazard import compute_boundaries, hazard_posterior, subject_loglik
    df = AD.survival_from_lineitem(spark, sf_dir)
    bounds, _ = compute_boundaries(df, 10)
    lam = hazard_posterior(df, 10).select("j", F.col("mean").alias("lam"))
    ll = subject_loglik(df, bounds, lam)
    return ll.groupBy("j").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("loglik").alias("loglik"))


# ---------------------------------------------------------------- Weibull

# Alpha nodes of the registered power-sum check.
WEIBULL_CHECK_ALPHAS = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0]


@query("a7_weibull_suffstats")
def a7_weibull_suffstats(spark, sf_dir):
    """n, r, L and S(alpha) = sum (t/max t)^alpha at fixed nodes."""
    from bayes_ops.operators.suffstats import power_sums
    df = AD.survival_from_lineitem(spark, sf_dir)
    top = df.where(F.col("duration").isNotNull() & F.col("observed").isNotNull()).agg(F.max("duration")).first()[0]
    nodes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("alpha"), F.col(f"s{k}").alias("s"))
                      for k, a in enumerate(WEIBULL_CHECK_ALPHAS)])
    return (power_sums(df, WEIBULL_CHECK_ALPHAS, float(top or 1.0), with_basic=True)
            .select("n", "r", "sum_log_t_obs", F.explode(nodes).alias("nd"))
            .select("n", "r", "sum_log_t_obs", "nd.k", "nd.alpha", "nd.s"))


@query("p5_weibull_posterior", median=5, hdi_3=3, hdi_97=3)
def p5_weibull_posterior(spark, sf_dir):
    """Weibull (alpha, beta) posterior by adaptive grid quadrature (P5)."""
    from bayes_ops.plans.weibull import weibull_posterior
    return weibull_posterior(AD.survival_from_lineitem(spark, sf_dir))


# ---------------------------------------------------------------- A/B

@query("a2_ab_suffstats")
def a2_ab_suffstats(spark, sf_dir):
    """Successes, trials, failures per variant (A2, V9)."""
    from bayes_ops.operators.suffstats import ab_stats
    return ab_stats(AD.ab_from_orders(spark, sf_dir))


@query("p2_ab_posterior", median=5, hdi_3=4, hdi_97=4)
def p2_ab_posterior(spark, sf_dir):
    """Hierarchical Beta-Bernoulli posterior of each variant's rate."""
    from bayes_ops.plans.ab import ab_posterior
    return ab_posterior(AD.ab_from_orders(spark, sf_dir))


# ---------------------------------------------------------------- draws and decisions

DRAW_SEED = 20240101


def _bandit_params(spark, sf_dir):
    from bayes_ops.operators.materialize import reliable_checkpoint
    from bayes_ops.plans.bandit import bandit_params
    return reliable_checkpoint(bandit_params(hist=AD.bandit_histogram_from_lineitem(spark, sf_dir)))


@query("c4_bandit_draws")
def c4_bandit_draws(spark, sf_dir):
    """1000 reproducible posterior draws of p and expected reward per arm."""
    from bayes_ops.operators.draws import posterior_draws
    p = _bandit_params(spark, sf_dir)
    d = posterior_draws(p, ["arm", "magnitude"], "beta", n=1000, seed=DRAW_SEED, label_keys=["arm"])
    return d.select("arm", "draw_id", F.col("value").alias("est_prob"),
                    (F.col("value") * F.col("magnitude")).alias("expected_reward"))


@query("c2_thompson_prob_best")
def c2_thompson_prob_best(spark, sf_dir):
    """Monte Carlo P(best arm) from 10000 shared draws per arm."""
    from bayes_ops.operators.compare import thompson
    return thompson(_bandit_params(spark, sf_dir), n=10000, seed=DRAW_SEED)


def _poisson_params_ckpt(spark, sf_dir):
    from bayes_ops.operators.materialize import reliable_checkpoint
    from bayes_ops.plans.poisson import poisson_params
    ev = AD.poisson_from_events(spark, sf_dir)
    return reliable_checkpoint(poisson_params(ev, EVENTS_START, EVENTS_END, group_by=["cohort"]))


@query("c5_poisson_draws")
def c5_poisson_draws(spark, sf_dir):
    """5000 posterior draws of each cohort's daily rate."""
    from bayes_ops.operators.draws import posterior_draws
    p = _poisson_params_ckpt(spark, sf_dir)
    return posterior_draws(p, ["cohort"], "gamma", n=5000, seed=DRAW_SEED).select("cohort", "draw_id", "value")


@query("n4_hdi_from_draws")
def n4_hdi_from_draws(spark, sf_dir):
    """94 % HDI of the cohort-rate draws: narrowest window of sorted draws."""
    from bayes_ops.operators.draws import hdi_from_draws
    return hdi_from_draws(c5_poisson_draws(spark, sf_dir), ["cohort"])


@query("n6_quantile_band")
def n6_quantile_band(spark, sf_dir):
    """2.5 % / 97.5 % order statistics and mean of the cohort-rate draws."""
    from bayes_ops.operators.draws import quantile_band
    return quantile_band(c5_poisson_draws(spark, sf_dir), ["cohort"])


@query("c1_prob_greater")
def c1_prob_greater(spark, sf_dir):
    """P(rate of cohort > rate of control cohort c0) for every other cohort."""
    from bayes_ops.operators.compare import against_control, prob_greater
    p = _poisson_params_ckpt(spark, sf_dir)
    return prob_greater(p, "cohort", against_control(p, "cohort", "c0"), "gamma")


# ---------------------------------------------------------------- Poisson variants, counts, views

@query("a5_event_counts_grouping_sets")
def a5_event_counts_grouping_sets(spark, sf_dir):
    """Event counts by cohort, by event_type and by both in one scan (A5, V9)."""
    from bayes_ops.operators.suffstats import event_counts_all_groupings
    from bayes_ops.operators import filters as flt
    ev = flt.apply(AD.poisson_from_events(spark, sf_dir), flt.time_window(EVENTS_START, EVENTS_END))
    return event_counts_all_groupings(ev)


@query("p4_poisson_cell_posterior")
def p4_poisson_cell_posterior(spark, sf_dir):
    """Per (cohort, event_type) cell, hourly rate, filtered by IN lists."""
    from bayes_ops.plans.poisson import poisson_posterior
    ev = AD.poisson_from_events(spark, sf_dir)
    return poisson_posterior(ev, EVENTS_START, EVENTS_END, cohort=["c0", "c1", "c2"],
                             event_type=["click", "purchase", "view"],
                             group_by=["cohort", "event_type"], unit="hour", population=150.0,
                             prior=(0.5, 0.1))


@query("a6_poisson_exposure_posterior")
def a6_poisson_exposure_posterior(spark, sf_dir):
    """Exposure taken from a column (summed per group) instead of the window."""
    from bayes_ops.plans.poisson import poisson_posterior
    ev = _events_with_exposure(spark, sf_dir)
    return poisson_posterior(ev, EVENTS_START, EVENTS_END, group_by=["event_type"], exposure_col="exposure")


def _events_with_exposure(spark, sf_dir):
    ev = AD.read_table(spark, sf_dir, "events")
    return AD.prepare_cohort(ev, None, {
        "timestamp": AD.utc_ts("ts"),
        "cohort": F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")),
        "event_type": F.col("event_type"),
        "exposure": F.col("value"),
    })


@query("p7_poisson_curve")
def p7_poisson_curve(spark, sf_dir):
    """200-point posterior density curve of each cohort's rate."""
    from bayes_ops.plans.poisson import poisson_curve
    return poisson_curve(AD.poisson_from_events(spark, sf_dir), EVENTS_START, EVENTS_END, group_by=["cohort"])


@query("v7_shared_axis")
def v7_shared_axis(spark, sf_dir):
    """Common x extent and 1.1 x max density over the cohort curves (V7)."""
    from bayes_ops.operators.views import shared_axis
    return shared_axis(p7_poisson_curve(spark, sf_dir))


@query("v3_rescaled_rates")
def v3_rescaled_rates(spark, sf_dir):
    """Cohort rates per user per hour: summary divided by users x 24 (V3)."""
    from bayes_ops.plans.poisson import poisson_posterior, rescale
    ev = AD.read_table(spark, sf_dir, "events")
    users = (ev.select(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("group_key"), "user_id")
             .groupBy("group_key").agg(F.countDistinct("user_id").cast("double").alias("exposure")))
    summ = poisson_posterior(AD.poisson_from_events(spark, sf_dir), EVENTS_START, EVENTS_END, group_by=["cohort"])
    return rescale(summ.drop("exposure"), users, unit="hour").select(
        "cohort", "mean", "sd", "median", "hdi_3", "hdi_97")


@query("l3_rank_arms_by_mean")
def l3_rank_arms_by_mean(spark, sf_dir):
    """Arms ranked by posterior mean of p, ascending (L3)."""
    from bayes_ops.operators.listing import rank_by
    from bayes_ops.plans.bandit import bandit_posterior
    t = bandit_posterior(hist=AD.bandit_histogram_from_lineitem(spark, sf_dir)).select("arm", "mean")
    return rank_by(t, [F.col("mean"), F.col("arm")])


@query("l4_cohorts_alphabetical")
def l4_cohorts_alphabetical(spark, sf_dir):
    """Cohorts with event counts, ranked alphabetically (L4, V9)."""
    from bayes_ops.operators.listing import rank_by
    ev = AD.poisson_from_events(spark, sf_dir)
    return rank_by(ev.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_events")), [F.col("cohort")])


@query("l1_list_events")
def l1_list_events(spark, sf_dir):
    """Page of events (offset 100, limit 1000) filtered by cohort, type and window."""
    from bayes_ops.functions.timefmt import iso_format
    from bayes_ops.operators.listing import list_events
    ev = AD.poisson_from_events(spark, sf_dir)
    page = list_events(ev, cohort=["c1", "c2"], event_type=["click", "view"], start="2024-01-03 00:00:00",
                       end="2024-01-20 00:00:00", limit=1000, offset=100)
    return page.select(iso_format(F.col("timestamp")).alias("timestamp"), "cohort", "event_type")


@query("l2_inspect_experiment")
def l2_inspect_experiment(spark, sf_dir):
    """First page (limit 100) of the A/B table in a window, with the total (L2, A10)."""
    from bayes_ops.functions.timefmt import iso_format
    from bayes_ops.operators.listing import inspect
    ab = AD.ab_from_orders(spark, sf_dir)
    page = inspect(ab, start="1995-01-01 00:00:00", end="1996-01-01 00:00:00", limit=100, offset=0)
    return page.select(iso_format(F.col("timestamp")).alias("timestamp"), "variant", "outcome", "total_count")


@query("n7_trial_sequence")
def n7_trial_sequence(spark, sf_dir):
    """Trial index and running successes per variant."""
    from bayes_ops.functions.timefmt import iso_format
    from bayes_ops.operators.listing import trial_sequence
    t = trial_sequence(AD.ab_from_orders(spark, sf_dir))
    return t.select("variant", "seq", iso_format(F.col("timestamp")).alias("timestamp"), "outcome",
                    "cum_successes")


@query("a12_time_extent")
def a12_time_extent(spark, sf_dir):
    """Observed event-time extent and max duration."""
    from bayes_ops.functions.timefmt import iso_format
    ev = AD.poisson_from_events(spark, sf_dir)
    mx = AD.survival_from_lineitem(spark, sf_dir).agg(F.max("duration").alias("max_duration"))
    return _extent(ev, mx)


def _extent(ev, mx):
    from bayes_ops.functions.timefmt import iso_format
    # max duration is a single scalar of another table: fetched, then a literal
    from bayes_ops.operators.suffstats import time_extent
    one = time_extent(ev, "timestamp", with_count=True)
    m = mx.first()["max_duration"]
    return one.select(iso_format(F.col("min_value")).alias("min_timestamp"),
                      iso_format(F.col("max_value")).alias("max_timestamp"),
                      "n", F.lit(m).cast("double").alias("max_duration"))


@query("v1_value_kde")
def v1_value_kde(spark, sf_dir):
    """Gaussian KDE (Scott bandwidth) of events.value per event type (V1, E5)."""
    from bayes_ops.operators.views import gaussian_kde
    ev = AD.read_table(spark, sf_dir, "events").select("event_type", "value")
    return gaussian_kde(ev, ["event_type"], "value")


@query("v2_timeline_density")
def v2_timeline_density(spark, sf_dir):
    """Epanechnikov timeline density of events per cohort on 200 ticks."""
    from bayes_ops.operators.views import epanechnikov_timeline
    t = epanechnikov_timeline(AD.poisson_from_events(spark, sf_dir), ["cohort"])
    return t.select("cohort", "j", F.round("tick").cast("long").alias("tick_ms"), "n",
                    (F.col("density") * F.lit(86400000.0)).alias("density_per_day"))


@query("v8_box_summary")
def v8_box_summary(spark, sf_dir):
    """Box-plot numbers of the expected-reward draws per arm (V8)."""
    from bayes_ops.operators.views import box_summary
    return box_summary(c4_bandit_draws(spark, sf_dir), ["arm"], "expected_reward")


@query("w3_validate_batch")
def w3_validate_batch(spark, sf_dir):
    """Validate events as an A/B batch (outcome from props.k): counts by reject reason."""
    from bayes_ops.sources.ingest import validate
    ev = AD.read_table(spark, sf_dir, "events")
    batch = ev.select(F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("variant"),
                      F.get_json_object("props", "$.k").alias("outcome"))
    v = validate(batch, "ab-test")
    return v.groupBy(F.coalesce(F.col("reject_reason"), F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@query("g9_delete_by_filter")
def g9_delete_by_filter(spark, sf_dir):
    """Rows a delete (cohort c1 and timestamp >= 2024-01-15) would remove, and survivors per cohort."""
    from bayes_ops.plans.registry_ops import delete_preview
    return delete_preview(AD.poisson_from_events(spark, sf_dir), {"cohort": "c1"}, start="2024-01-15 00:00:00")


@query("g9_delete_rows")
def g9_delete_rows(spark, sf_dir):
    """Rows per cohort of an experiment table after a real delete."""
    import uuid
    from bayes_ops.session import scratch_path
    from bayes_ops.sources import registry as R
    root = scratch_path(spark, f"g9-{uuid.uuid4().hex}")
    R.create_experiment(spark, root, "events", "poisson-cohorts", "Events", AD.poisson_from_events(spark, sf_dir))
    R.delete_by_filter(spark, root, "events", {"cohort": "c1"}, start="2024-01-15 00:00:00")
    return R.read_experiment(spark, root, "events").groupBy("cohort").agg(F.count(F.lit(1)).alias("n_rows"))


@query("s4_csv_batch")
def s4_csv_batch(spark, sf_dir):
    """Events written as CSV, read back as a text batch and validated."""
    import uuid
    from bayes_ops.functions.timefmt import iso_format
    from bayes_ops.session import scratch_path
    from bayes_ops.sources.ingest import read_csv_batch, validate
    path = scratch_path(spark, f"s4-{uuid.uuid4().hex}")
    ev = AD.poisson_from_events(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("string"))
    ev.write.option("header", True).csv(path)
    v = validate(read_csv_batch(spark, path), "poisson-cohorts")
    good = F.col("reject_reason").isNull()
    return v.groupBy("cohort", "event_type").agg(
        F.count(F.when(good, 1)).alias("n_rows"), F.count(F.when(~good, 1)).alias("n_rejected"),
        iso_format(F.max("timestamp")).alias("last_event"))


@query("k1_fingerprint")
def k1_fingerprint(spark, sf_dir):
    """Order-free fingerprints of the six adapted experiment tables (K1)."""
    from bayes_ops.operators.cache import fingerprint
    frames = [fingerprint(AD.experiment_frame(spark, sf_dir, k)).withColumn("kind", F.lit(k))
              for k in AD.ADAPTERS]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("kind", "n_rows", "fingerprint")


@query("g6_describe_table")
def g6_describe_table(spark, sf_dir):
    """Columns, SQL types, nullability and row count of the lineitem table."""
    from bayes_ops.sources.registry import describe
    return describe(AD.read_table(spark, sf_dir, "lineitem"))


# ---------------------------------------------------------------- streaming

def _events_stream(spark, sf_dir):
    """The events table as a stream of its files.  A stream lists the direct children of a folder: those
    of the table where it is a folder of part files, else of ``sf_dir``, of which one is the table."""
    from bayes_ops.sources.tables import is_folder
    path = f"{sf_dir}/events.parquet"
    r = (spark.readStream.schema(AD.read_table(spark, sf_dir, "events").schema)
         .option("maxFilesPerTrigger", 1))
    raw = r.parquet(path) if is_folder(spark, path) else r.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return AD.prepare_cohort(raw, None, {
        "timestamp": AD.utc_ts("ts"),
        "cohort": F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")),
        "event_type": F.col("event_type"),
    })


@query("t2_stream_poisson_posterior")
def t2_stream_poisson_posterior(spark, sf_dir):
    """Running cohort-rate posterior maintained by a streaming aggregate over the
    events files; equals the batch posterior (T2, T1 source, P4)."""
    import uuid
    from bayes_ops.operators import filters as flt
    from bayes_ops.plans.poisson import window_exposure
    from bayes_ops.session import scratch_path
    from bayes_ops.streaming.stats import poisson_snapshot, read_snapshot, running_counts, start_running_posterior
    base = scratch_path(spark, f"t2-{uuid.uuid4().hex}")
    ev = flt.apply(_events_stream(spark, sf_dir), flt.time_window(EVENTS_START, EVENTS_END))
    q = start_running_posterior(running_counts(ev, ["cohort"]), base + "/posterior", base + "/checkpoint",
                                poisson_snapshot(["cohort"], window_exposure(EVENTS_START, EVENTS_END)))
    q.awaitTermination()
    return read_snapshot(spark, base + "/posterior").select(
        "cohort", "param", "n_events", "exposure", "alpha", "beta", "mean", "sd", "median", "hdi_3", "hdi_97")


@query("t3_windowed_rates")
def t3_windowed_rates(spark, sf_dir):
    """Daily tumbling-window rate posterior per cohort (T3, batch form of the stream)."""
    from bayes_ops.streaming.stats import windowed_counts, windowed_rates
    c = windowed_counts(AD.poisson_from_events(spark, sf_dir), ["cohort"], "1 day")
    r = windowed_rates(c, ["cohort"])
    from bayes_ops.functions.timefmt import iso_format
    return r.select(iso_format(F.col("window_start")).alias("window_start"), "cohort", "n_events", "exposure",
                    "alpha", "beta", "mean", "sd", "median", "hdi_3", "hdi_97")


@query("p11_hier_poisson_posterior", mean=5, sd=5, median=4, hdi_3=2, hdi_97=2)
def p11_hier_poisson_posterior(spark, sf_dir):
    """Cohort rates partially pooled within each event type."""
    from bayes_ops.plans.hier_poisson import hier_poisson_posterior
    return hier_poisson_posterior(AD.poisson_from_events(spark, sf_dir), EVENTS_START, EVENTS_END)


@query("v5_weibull_traces", alpha=3, beta=3, x=2, y=3)
def v5_weibull_traces(spark, sf_dir):
    """30 sampled Weibull pdfs from the posterior marginals plus the alpha = 1
    reference trace at the median beta, 200 x points each (V5, V6, E2)."""
    from bayes_ops.plans.weibull import weibull_traces_from
    t = weibull_traces_from(AD.survival_from_lineitem(spark, sf_dir), 30, DRAW_SEED)
    return t.select("draw_id", "k", "alpha", "beta", "x", "y", "reference")


@query("j2_pull_outcomes")
def j2_pull_outcomes(spark, sf_dir):
    """Row-level success labels via the magnitude lookup join, summed per arm."""
    from bayes_ops.operators.suffstats import pull_outcomes
    o = pull_outcomes(AD.bandit_from_lineitem(spark, sf_dir))
    return o.groupBy("arm").agg(F.first("magnitude", ignorenulls=True).alias("magnitude"),
                                F.count(F.lit(1)).alias("pulls"), F.sum("outcome").alias("successes"))


@query("p7_bernoulli_curve")
def p7_bernoulli_curve(spark, sf_dir):
    """200-point Beta posterior density of the purchase probability."""
    from bayes_ops.plans.bernoulli import bernoulli_curve
    return bernoulli_curve(AD.bernoulli_from_events(spark, sf_dir))


@query("n3_posterior_cdf")
def n3_posterior_cdf(spark, sf_dir):
    """Posterior CDF of each cohort's rate on its 2000-cell grid."""
    from bayes_ops.operators.grid import family_support, grid_posterior
    from bayes_ops.plans.poisson import poisson_params
    p = poisson_params(AD.poisson_from_events(spark, sf_dir), EVENTS_START, EVENTS_END, group_by=["cohort"])
    lo, hi, logp, t = family_support("gamma", F.col("alpha"), F.col("beta"))
    g = grid_posterior(p.select("cohort", "param", "alpha", "beta"), ["cohort", "param"], lo, hi, logp, transform=t)
    return g.select("cohort", "i", "x", "w", "cdf")


@query("e9_parse_timestamps")
def e9_parse_timestamps(spark, sf_dir):
    """Timestamp parsing of text forms of events.ts (E9, E11): Unix seconds and
    ISO text agree; a bare yyyyMMdd is read as a Unix number first."""
    from bayes_ops.functions.timefmt import iso_format, parse_timestamp
    ev = AD.read_table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("t"))
    txt = ev.select("event_type",
                    F.unix_seconds("t").cast("string").alias("unix"),
                    F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
                    F.date_format("t", "yyyy-MM-dd").alias("day"),
                    F.date_format("t", "yyyyMMdd").alias("compact"))
    p = txt.select("event_type", parse_timestamp(F.col("unix")).alias("pu"), parse_timestamp(F.col("iso")).alias("pi"),
                   parse_timestamp(F.col("day")).alias("pd"), parse_timestamp(F.col("compact")).alias("pc"),
                   "compact")
    return p.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("pu") == F.col("pi"), 1).otherwise(0)).cast("long").alias("n_unix_eq_iso"),
        F.sum(F.when(F.col("pc") == F.timestamp_seconds(F.col("compact").cast("long")), 1).otherwise(0))
        .cast("long").alias("n_compact_as_unix"),
        iso_format(F.min("pd")).alias("min_day"), iso_format(F.max("pd")).alias("max_day"))


@query("p7_ab_curve", y=3)
def p7_ab_curve(spark, sf_dir):
    """Posterior density of each variant's rate under the hierarchical model."""
    from bayes_ops.plans.ab import ab_curve
    return ab_curve(AD.ab_from_orders(spark, sf_dir))


@query("p7_weibull_curves", x=5, y=3)
def p7_weibull_curves(spark, sf_dir):
    """Marginal posterior densities of the Weibull shape and scale."""
    from bayes_ops.plans.weibull import weibull_curves
    return weibull_curves(AD.survival_from_lineitem(spark, sf_dir))


@query("t1_stream_ingest")
def t1_stream_ingest(spark, sf_dir):
    """Events streamed through kind validation into a Parquet table with the
    exactly-once file sink; accepted and rejected rows per event type (T1, W3)."""
    import uuid
    from bayes_ops.session import scratch_path
    from bayes_ops.streaming.ingest import start_ingest
    base = scratch_path(spark, f"t1-{uuid.uuid4().hex}")
    raw = _events_stream(spark, sf_dir).select(F.col("timestamp").cast("string").alias("timestamp"),
                                               "cohort", "event_type")
    start_ingest(raw, "poisson-cohorts", base + "/table", base + "/checkpoint").awaitTermination()
    t = spark.read.parquet(base + "/table")
    return t.groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n_rows"))


@query("t4_stream_dedupe")
def t4_stream_dedupe(spark, sf_dir):
    """Events streamed with their key, a third of them delivered again: accepted rows per type (T4)."""
    import uuid
    from bayes_ops.session import scratch_path
    from bayes_ops.streaming.ingest import event_stream, start_ingest
    base = scratch_path(spark, f"t4-{uuid.uuid4().hex}")
    ev = AD.read_table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"), AD.utc_ts("ts").cast("string").alias("timestamp"),
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("cohort"), "event_type")
    ev.write.json(base + "/source")
    ev.where(F.col("event_id").cast("long") % 3 == 0).write.mode("append").json(base + "/source")
    raw = event_stream(spark, base + "/source", "poisson-cohorts", key="event_id", max_files_per_trigger=1)
    start_ingest(raw, "poisson-cohorts", base + "/table", base + "/checkpoint", key="event_id").awaitTermination()
    t = spark.read.parquet(base + "/table").where(F.col("status") == "ok")
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_keys"))


@query("t3_stream_window_counts")
def t3_stream_window_counts(spark, sf_dir):
    """Daily event counts per cohort from a watermarked streaming window
    aggregation, open windows included (T3)."""
    import uuid
    from bayes_ops.functions.timefmt import iso_format
    from bayes_ops.session import scratch_path
    from bayes_ops.streaming.stats import read_windows, start_windowed
    base = scratch_path(spark, f"t3-{uuid.uuid4().hex}")
    # the table's files carry no time order, so no row of it may be late: the watermark spans it
    at = F.unix_seconds(AD.utc_ts("ts"))
    span = AD.read_table(spark, sf_dir, "events").agg((F.max(at) - F.min(at)).alias("s")).first()["s"] or 0
    start_windowed(_events_stream(spark, sf_dir).select("timestamp", "cohort"), ["cohort"], base + "/table",
                   base + "/checkpoint", window="1 day", watermark=f"{span + 3600} seconds").awaitTermination()
    t = read_windows(spark, base + "/table", ["cohort"])
    return t.select(iso_format(F.col("window_start")).alias("window_start"), "cohort", "n_events")


@query("x1_density_kind", median=5, hdi_3=4, hdi_97=4)
def x1_density_kind(spark, sf_dir):
    """A kind given by its columns, sufficient statistics and log density alone (2.15): log-normal durations,
    mu ~ Normal(0, 10), sigma ~ HalfNormal(1), per observed flag."""
    from bayes_ops import kinds
    from bayes_ops.operators.adaptive import Parameter

    def sums(df, group_by):
        lt = F.when(F.col("duration") > 0, F.log("duration"))
        return df.groupBy(*group_by).agg(F.count(lt).alias("n"), F.sum(lt).alias("l"), F.sum(lt * lt).alias("q"))

    def logp(p):
        n, l, q, mu, sigma = F.col("n"), F.col("l"), F.col("q"), p["mu"], p["sigma"]
        return (-n * F.log(sigma) - (q - 2 * mu * l + n * mu * mu) / (2 * sigma * sigma)
                - mu * mu / 200 - sigma * sigma / 2)

    kinds.register_density("lognormal-durations", [("duration", T.DoubleType()), ("observed", T.BooleanType())],
                           [Parameter("mu"), Parameter("sigma", "positive")], sums, logp)
    return kinds.posterior("lognormal-durations", AD.survival_from_lineitem(spark, sf_dir), group_by=["observed"])


# ---------------------------------------------------------------- table lifecycle and result cache

def _root(spark, name: str) -> str:
    import uuid
    from bayes_ops.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("g1_registry_lifecycle")
def g1_registry_lifecycle(spark, sf_dir):
    """Registry made, four experiments created from the tables, one dropped with its data, the rest listed, by kind and
    looked up, with the rows of each (G1, G2, G3, G4, G5, S1, S5, S7)."""
    from bayes_ops.sources import registry as R
    root = _root(spark, "g1")
    R.init_registry(spark, root)
    for kind in ("poisson-cohorts", "ab-test", "weibull", "bernoulli"):
        R.create_experiment(spark, root, f"exp {kind}", kind, kind.upper(), AD.experiment_frame(spark, sf_dir, kind))
    R.drop_experiment(spark, root, "exp bernoulli")
    out = None
    for name in R.list_tables(spark, root):
        kind = R.lookup(spark, root, name)["type"]
        one = R.list_experiments(spark, root, kind).select("name", "type", "display_name", "status").crossJoin(
            R.read_experiment(spark, root, name, kind).agg(F.count("*").alias("n_rows")))   # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query("g7_kind_columns")
def g7_kind_columns(spark, sf_dir):
    """Columns and types of the kinds (G7), each with the values that its adapted table holds for it."""
    from bayes_ops.sources import registry as R
    from bayes_ops.sources.tables import conform
    out = None
    for kind in AD.ADAPTERS:
        frame = conform(AD.experiment_frame(spark, sf_dir, kind), kind)
        counts = frame.agg(*[F.count(c).alias(c) for c in frame.columns])
        long = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_values")) for c in frame.columns])).alias("x")).select("x.*")
        one = R.kind_schemas(spark, kind).join(long, "name").select("experiment_type", "position", "name", "type", "n_values")
        out = one if out is None else out.unionByName(one)
    return out


@query("g8_migrate_column")
def g8_migrate_column(spark, sf_dir):
    """Outcomes of a bernoulli table stored under the old column name, read after the migration."""
    import time
    from bayes_ops.sources import registry as R
    root = _root(spark, "g8")
    R.init_registry(spark, root)
    AD.bernoulli_from_events(spark, sf_dir).withColumnRenamed("outcome", "conversion").write.parquet(R.data_path(root, "old", 1))
    R._append(spark, root, [("old", "bernoulli", "Old", "created", R._now(), 1, time.time_ns())])
    n = R.migrate_conversion_column(spark, root)
    return R.read_experiment(spark, root, "old", "bernoulli").groupBy("outcome").agg(F.count("*").alias("n_rows")).withColumn("migrated", F.lit(n))


@query("s3_json_batch")
def s3_json_batch(spark, sf_dir):
    """Events written as JSON arrays, read back as a text batch and validated."""
    from bayes_ops.functions.timefmt import iso_format
    from bayes_ops.sources.ingest import read_json_batch, validate
    path = _root(spark, "s3")
    ev = AD.poisson_from_events(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("string"))
    row = F.struct("timestamp", "cohort", "event_type")
    arrays = ev.groupBy(F.pmod(F.xxhash64(row), F.lit(8)).alias("file")).agg(F.to_json(F.collect_list(row)).alias("value"))
    arrays.repartition("file").write.partitionBy("file").text(path)      # one array a file
    v = validate(read_json_batch(spark, path + "/file=*"), "poisson-cohorts")
    good = F.col("reject_reason").isNull()
    return v.groupBy("cohort", "event_type").agg(
        F.count(F.when(good, 1)).alias("n_rows"), F.count(F.when(~good, 1)).alias("n_rejected"),
        iso_format(F.max("timestamp")).alias("last_event"))


@query("s6_append_batch")
def s6_append_batch(spark, sf_dir):
    """An experiment of the events before 15 January and a batch with the others, of which those of users 7 mod 100 have an
    unreadable time: rows per cohort, rows accepted and rejected (S6, W3, S5)."""
    from bayes_ops.sources import registry as R
    root = _root(spark, "s6")
    ev = AD.poisson_from_events(spark, sf_dir)
    cut = F.col("timestamp") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    R.create_experiment(spark, root, "events", "poisson-cohorts", "Events", ev.where(cut))
    raw = AD.read_table(spark, sf_dir, "events")
    late = raw.where(AD.utc_ts("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp")).select(
        F.when(F.col("user_id") % 100 == 7, F.lit("no time")).otherwise(AD.utc_ts("ts").cast("string")).alias("timestamp"),
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("cohort"), "event_type")
    n, bad = R.append_events(spark, root, "events", late)
    held = R.read_experiment(spark, root, "events").groupBy("cohort").agg(F.count("*").alias("n_rows"))
    return held.crossJoin(bad.agg(F.count("*").alias("rejected"))).withColumn("accepted", F.lit(n).cast("long"))   # one row


@query("k2_result_cache")
def k2_result_cache(spark, sf_dir):
    """The rate posterior from the result cache: a miss, a hit, a listing and a clearing."""
    from bayes_ops.operators import cache as C
    path = _root(spark, "k2") + "/results"
    ev = AD.poisson_from_events(spark, sf_dir)
    fit = lambda d: p4_fit(d)
    _, first = C.get_or_compute(spark, path, "events", "poisson", ev, fit, {"by": "cohort"})
    got, second = C.get_or_compute(spark, path, "events", "poisson", ev, fit, {"by": "cohort"})
    listed = C.list_cached(spark, path, "events").count()
    got = got.select("cohort", "n_events", "mean", "hdi_3", "hdi_97").withColumns({
        "hit_first": F.lit(first), "hit_second": F.lit(second), "listed": F.lit(listed).cast("long"),
        "cleared": F.lit(C.clear_cached(spark, path, "events")).cast("long")})
    return got.withColumn("left", F.lit(C.list_cached(spark, path, "events").count()).cast("long"))


def p4_fit(df):
    from bayes_ops.plans.poisson import poisson_posterior
    return poisson_posterior(df, EVENTS_START, EVENTS_END, group_by=["cohort"])


@query("t2_stream_bandit")
def t2_stream_bandit(spark, sf_dir):
    """Running Beta parameters per arm, a state of one row per arm, from a stream of the lineitem pulls."""
    from bayes_ops.streaming.stats import read_snapshot, start_running_bandit
    base = _root(spark, "t2b")
    AD.bandit_from_lineitem(spark, sf_dir).select("arm", "reward").repartition(4).write.parquet(base + "/in")
    stream = spark.readStream.schema("arm string, reward double").option("maxFilesPerTrigger", 1).parquet(base + "/in")
    start_running_bandit(stream, base + "/out", base + "/checkpoint").awaitTermination()
    return read_snapshot(spark, base + "/out").select("arm", "magnitude", "pulls", "successes", "alpha", "beta", "est_prob")


@query("t3_sliding_windows")
def t3_sliding_windows(spark, sf_dir):
    """Events per cohort in windows of two days, a day apart (T3, sliding form)."""
    from bayes_ops.functions.timefmt import iso_format
    from bayes_ops.streaming.stats import windowed_counts
    t = windowed_counts(AD.poisson_from_events(spark, sf_dir), ["cohort"], "2 days", "1 day")
    return t.select(iso_format(F.col("window_start")).alias("window_start"), iso_format(F.col("window_end")).alias("window_end"),
                    "cohort", "n_events")
