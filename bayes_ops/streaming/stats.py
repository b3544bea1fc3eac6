"""Continuously updated posteriors and windowed rates (ops T2, T3).

T2: the sufficient statistics are streaming aggregates (state = one row per
group); each micro-batch writes the
small posterior table, computed from the complete aggregate with the same
stateless posterior maths as the batch plans, to a version of its own and
then a pointer to it.  ``read_snapshot`` follows the pointer, so a reader
never meets a half-written table, and a replayed batch leaves the same result.

A bandit arm's successes are the pulls at its largest reward, which may still
grow.  Its state (largest positive reward, pulls at it, all pulls) merges with
that of a batch: of two unlike maxima the smaller one's count is dropped, of equal ones the counts add
up.  ``start_running_bandit`` keeps one such row per arm in the versioned snapshot, so
continuous rewards cost no more than coarse ones.

T3: tumbling (or sliding) event-time windows with a watermark; rows later
than the watermark are dropped by Spark.  Each micro-batch writes the windows
that it changed; ``read_windows`` takes the newest count of every window, so
windows still open when a run ends are there too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bayes_ops.functions.timefmt import unit_seconds
from bayes_ops.operators.cache import read_or_empty
from bayes_ops.operators.grid import conjugate_summary


def running_counts(events: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Streaming k per group (state: one row per group)."""
    return events.groupBy(*group_by).agg(F.count(F.lit(1)).alias("n_events"))


def running_bernoulli(trials: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    out = F.col("outcome").cast("long")
    g = trials.groupBy(*keys) if keys else trials.groupBy()
    return g.agg(F.sum(F.coalesce(out, F.lit(0))).alias("successes"), F.count(out).alias("trials"))


def bandit_state(pulls: DataFrame) -> DataFrame:
    """(arm, magnitude, at_max, pulls) of a batch: largest positive reward, pulls at it, all pulls."""
    each = (pulls.where(F.col("arm").isNotNull() & F.col("reward").isNotNull())
            .groupBy("arm", "reward").agg(F.count(F.lit(1)).alias("cnt")))
    paid = F.when(F.col("reward") > 0, F.col("reward"))
    return each.groupBy("arm").agg(F.max(paid).alias("magnitude"), F.max_by(F.when(paid.isNotNull(), F.col("cnt")), paid).alias("at_max"),
                                   F.sum("cnt").alias("pulls"))


def merge_bandit_states(states: DataFrame) -> DataFrame:
    """One (arm, magnitude, at_max, pulls) row per arm from any number of them."""
    top = states.groupBy("arm", "magnitude").agg(F.sum("at_max").alias("at_max"), F.sum("pulls").alias("pulls"))
    return top.groupBy("arm").agg(F.max("magnitude").alias("magnitude"), F.max_by("at_max", "magnitude").alias("at_max"),
                                  F.sum("pulls").alias("pulls"))


def bandit_params_of(state: DataFrame, prior: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Beta parameters per arm of a merged state (as ``plans.bandit.bandit_params`` of all pulls)."""
    a0, b0 = prior
    won = F.coalesce("at_max", F.lit(0).cast("long"))
    st = state.select("arm", "magnitude", "pulls", won.alias("successes"), (F.col("pulls") - won).alias("failures"))
    return (st.withColumn("alpha", F.lit(float(a0)) + F.col("successes").cast("double"))
            .withColumn("beta", F.lit(float(b0)) + F.col("failures").cast("double"))
            .withColumn("est_prob", F.col("alpha") / (F.col("alpha") + F.col("beta")))
            .withColumn("expected_reward", F.col("est_prob") * F.col("magnitude")))


def start_running_bandit(pulls: DataFrame, path: str, checkpoint: str, posterior: Callable[[DataFrame], DataFrame] | None = None,
                         available_now: bool = True) -> StreamingQuery:
    """Start T2 for bandits: every micro-batch merges its state with the newest one and writes state and posterior
    (of ``bandit_params_of``; None: those parameters) as a version, then the pointer.  A replayed batch merges
    with the state before it and overwrites its version."""
    shape = "arm string, magnitude double, at_max long, pulls long"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        states = bandit_state(batch)
        before = read_or_empty(spark, f"{path}/latest", "id long").where(F.col("id") < batch_id).agg(F.max("id")).first()[0]
        if before is not None:
            states = states.unionByName(spark.read.schema(shape).parquet(f"{path}/state/{before}"))
        merge_bandit_states(states).write.mode("overwrite").parquet(f"{path}/state/{batch_id}")
        params = bandit_params_of(spark.read.schema(shape).parquet(f"{path}/state/{batch_id}"))
        (params if posterior is None else posterior(params)).write.mode("overwrite").parquet(f"{path}/versions/{batch_id}")
        spark.range(batch_id, batch_id + 1).coalesce(1).write.mode("append").parquet(f"{path}/latest")

    w = pulls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def running_reward_histogram(pulls: DataFrame) -> DataFrame:
    return (pulls.where(F.col("arm").isNotNull() & F.col("reward").isNotNull())
            .groupBy("arm", "reward").agg(F.count(F.lit(1)).alias("cnt")))


def snapshot_writer(path: str, posterior: Callable[[DataFrame], DataFrame]):
    """foreachBatch function: posterior(complete aggregate) -> a version of ``path``, then the pointer."""
    def write(batch: DataFrame, batch_id: int) -> None:
        posterior(batch).write.mode("overwrite").parquet(f"{path}/versions/{batch_id}")
        batch.sparkSession.range(batch_id, batch_id + 1).coalesce(1).write.mode("append").parquet(f"{path}/latest")
    return write


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete snapshot of a running posterior."""
    version = spark.read.parquet(f"{path}/latest").agg(F.max("id")).first()[0]
    return spark.read.parquet(f"{path}/versions/{version}")


def start_running_posterior(agg: DataFrame, path: str, checkpoint: str,
                            posterior: Callable[[DataFrame], DataFrame],
                            available_now: bool = True) -> StreamingQuery:
    """Start T2: complete-mode aggregate -> posterior snapshot table."""
    w = (agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(snapshot_writer(path, posterior)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def poisson_snapshot(group_by: Sequence[str], exposure: float, prior=(1.0, 1.0)) -> Callable[[DataFrame], DataFrame]:
    """Posterior maths for a running-count batch (same as the batch plan P4)."""
    def post(counts: DataFrame) -> DataFrame:
        a0, b0 = prior
        p = (counts.withColumn("param", F.lit("rate")).withColumn("exposure", F.lit(float(exposure)))
             .withColumn("alpha", F.lit(float(a0)) + F.col("n_events").cast("double"))
             .withColumn("beta", F.lit(float(b0)) + F.col("exposure")))
        return conjugate_summary(p, list(group_by) + ["param"], "gamma")
    return post


def windowed_counts(events: DataFrame, group_by: Sequence[str], window: str = "1 day",
                    slide: str | None = None, watermark: str | None = "1 hour") -> DataFrame:
    """k per (event-time window, group) (T3); works on batch and streaming frames."""
    e = events.withWatermark("timestamp", watermark) if (watermark and events.isStreaming) else events
    win = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    return (e.groupBy(win.alias("w"), *group_by).agg(F.count(F.lit(1)).alias("n_events"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *group_by, "n_events"))


def windowed_rates(counts: DataFrame, group_by: Sequence[str], unit: str = "day",
                   prior=(1.0, 1.0)) -> DataFrame:
    """Gamma posterior of the rate in each window: E = window length / unit."""
    a0, b0 = prior
    secs = F.unix_seconds(F.col("window_end")) - F.unix_seconds(F.col("window_start"))
    p = (counts.withColumn("exposure", secs.cast("double") / F.lit(unit_seconds(unit)))
         .withColumn("param", F.lit("rate"))
         .withColumn("alpha", F.lit(float(a0)) + F.col("n_events").cast("double"))
         .withColumn("beta", F.lit(float(b0)) + F.col("exposure")))
    return conjugate_summary(p, ["window_start"] + list(group_by) + ["param"], "gamma")


def start_windowed(events: DataFrame, group_by: Sequence[str], sink_dir: str, checkpoint: str,
                   window: str = "1 day", watermark: str = "1 hour",
                   available_now: bool = True) -> StreamingQuery:
    """Start T3: window counts, the changed ones of each micro-batch in a folder of its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")

    counts = windowed_counts(events, group_by, window, watermark=watermark)
    w = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_windows(spark: SparkSession, sink_dir: str, group_by: Sequence[str]) -> DataFrame:
    """window_start, window_end, group columns and the newest n_events of every window."""
    keys = ["window_start", "window_end", *group_by]
    return spark.read.parquet(sink_dir).groupBy(*keys).agg(F.max_by("n_events", "batch").alias("n_events"))
