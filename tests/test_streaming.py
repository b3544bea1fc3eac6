"""Streaming ingest, dedupe, running posteriors and windowed counts."""

import json
import os
import shutil

from pyspark.sql import functions as F

from bayes_ops.sources import adapters as AD
from bayes_ops.streaming.ingest import event_stream, read_ingested, start_ingest
from bayes_ops.streaming.stats import (read_snapshot, read_windows, running_reward_histogram,
                                       start_running_posterior, start_windowed, windowed_counts)
from tests.conftest import SF001


def _event_batches(spark, src, n_files=3, with_key=True, bad_rows=False):
    ev = AD.read_table(spark, SF001, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("cohort"),
        F.col("event_type"))
    if not with_key:
        ev = ev.drop("event_id")
    if bad_rows:
        ev = ev.withColumn("timestamp", F.when(F.col("event_type") == "error", F.lit("not a time"))
                           .otherwise(F.col("timestamp")))
    pdf = ev.toPandas().sort_values("timestamp")
    step = -(-len(pdf) // n_files)
    chunks = [pdf.iloc[i * step:(i + 1) * step] for i in range(n_files)]
    for i, c in enumerate(chunks):
        c.to_json(os.path.join(src, f"batch-{i}.json"), orient="records", lines=True)
    return pdf


def test_stream_ingest_with_rejects_and_restart(spark, workdir):
    src, sink, ck = (os.path.join(workdir, p) for p in ("src", "sink", "ck"))
    os.makedirs(src)
    pdf = _event_batches(spark, src, bad_rows=True)
    q = start_ingest(event_stream(spark, src, "poisson-cohorts"), "poisson-cohorts", sink, ck)
    q.awaitTermination()
    ok = read_ingested(spark, sink, "poisson-cohorts")
    n_bad = (pdf.event_type == "error").sum()
    assert ok.count() == len(pdf) - n_bad
    rej = spark.read.parquet(sink).where("status = 'rejected'")
    assert rej.count() == n_bad and {r.reject_reason for r in rej.collect()} == {"bad_timestamp"}
    # restart on the same checkpoint: nothing is written twice
    q2 = start_ingest(event_stream(spark, src, "poisson-cohorts"), "poisson-cohorts", sink, ck)
    q2.awaitTermination()
    assert read_ingested(spark, sink, "poisson-cohorts").count() == len(pdf) - n_bad


def test_stream_dedupe_same_batch_twice(spark, workdir):
    src, sink, ck = (os.path.join(workdir, p) for p in ("src", "sink", "ck"))
    os.makedirs(src)
    pdf = _event_batches(spark, src, n_files=2)
    shutil.copy(os.path.join(src, "batch-0.json"), os.path.join(src, "batch-0-again.json"))
    raw = event_stream(spark, src, "poisson-cohorts", key="event_id", max_files_per_trigger=1)
    q = start_ingest(raw, "poisson-cohorts", sink, ck, key="event_id")
    q.awaitTermination()
    assert read_ingested(spark, sink, "poisson-cohorts").count() == len(pdf)


def test_late_rows_and_repeats_across_batches(spark, workdir):
    src, sink, ck = (os.path.join(workdir, p) for p in ("src", "sink", "ck"))
    os.makedirs(src)
    files = [[("1", "2024-01-20 10:00:00"), ("1", "2024-01-20 10:00:00"), ("2", "2024-01-20 11:00:00")],
             [("3", "2024-01-21 10:00:00"), ("2", "2024-01-20 11:00:00"), (None, "2024-01-21 10:00:00")],
             [("4", "2024-01-02 10:00:00"), ("4", "2024-01-02 10:00:00"), (None, "2024-01-21 10:00:00"), ("5", "no time")],
             [("4", "2024-01-02 10:00:00"), ("1", "2024-01-20 10:00:00")]]
    for i, rows in enumerate(files):
        with open(os.path.join(src, f"f{i}.json"), "w") as f:
            for k, t in rows:
                f.write(json.dumps({"event_id": k, "timestamp": t, "cohort": "c", "event_type": "view"}) + "\n")
        raw = event_stream(spark, src, "poisson-cohorts", key="event_id", max_files_per_trigger=1)
        start_ingest(raw, "poisson-cohorts", sink, ck, key="event_id").awaitTermination()
    got = spark.read.parquet(sink)
    ok = sorted(str(r.event_id) for r in got.where("status = 'ok'").collect())
    assert ok == ["1", "2", "3", "4", "None", "None"]
    assert [(r.event_id, r.reject_reason) for r in got.where("status = 'rejected'").collect()] == [("5", "bad_timestamp")]
    assert read_ingested(spark, sink, "poisson-cohorts").count() == 6


def test_running_bandit_posterior_equals_batch(spark, workdir):
    from bayes_ops.operators.suffstats import bandit_stats, bandit_stats_from_histogram
    src, out, ck = (os.path.join(workdir, p) for p in ("src", "out", "ck"))
    os.makedirs(src)
    pulls = AD.bandit_from_lineitem(spark, SF001)
    pdf = pulls.select(F.col("timestamp").cast("string").alias("timestamp"), "arm",
                       F.col("reward").cast("string").alias("reward")).toPandas()
    for i in range(3):
        pdf.iloc[i::3].to_json(os.path.join(src, f"p{i}.json"), orient="records", lines=True)
    raw = event_stream(spark, src, "multi-armed-bandits", max_files_per_trigger=1)
    typed = raw.select(F.col("arm"), F.col("reward").cast("double").alias("reward"))
    q = start_running_posterior(running_reward_histogram(typed), out, ck, bandit_stats_from_histogram)
    q.awaitTermination()
    got = {r.arm: (r.pulls, r.successes, r.magnitude) for r in read_snapshot(spark, out).collect()}
    want = {r.arm: (r.pulls, r.successes, r.magnitude) for r in bandit_stats(pulls).collect()}
    assert got == want


def test_stream_windows_equal_batch(spark, workdir):
    src, sink, ck = (os.path.join(workdir, p) for p in ("src", "sink", "ck"))
    os.makedirs(src)
    pdf = _event_batches(spark, src, n_files=1, with_key=False)
    raw = event_stream(spark, src, "poisson-cohorts")
    ev = raw.select(F.col("timestamp").cast("timestamp").alias("timestamp"), "cohort")
    q = start_windowed(ev, ["cohort"], sink, ck, window="1 day", watermark="1 hour")
    q.awaitTermination()
    streamed = {(str(r.window_start), r.cohort): r.n_events for r in read_windows(spark, sink, ["cohort"]).collect()}
    batch = {(str(r.window_start), r.cohort): r.n_events
             for r in windowed_counts(AD.poisson_from_events(spark, SF001), ["cohort"], "1 day").collect()}
    assert streamed == batch   # open windows too
    assert len(pdf) > 0


def test_running_ab_stats_equal_batch(spark, workdir):
    from bayes_ops.operators.suffstats import ab_stats
    from bayes_ops.streaming.stats import running_bernoulli
    src, out, ck = (os.path.join(workdir, p) for p in ("src", "out", "ck"))
    os.makedirs(src)
    ab = AD.ab_from_orders(spark, SF001)
    pdf = ab.select(F.col("timestamp").cast("string").alias("timestamp"), "variant",
                    F.col("outcome").cast("string").alias("outcome")).toPandas()
    for i in range(4):
        pdf.iloc[i::4].to_json(os.path.join(src, f"b{i}.json"), orient="records", lines=True)
    raw = event_stream(spark, src, "ab-test", max_files_per_trigger=1)
    typed = raw.select("variant", F.col("outcome").cast("long").alias("outcome"))
    q = start_running_posterior(running_bernoulli(typed, ["variant"]), out, ck, lambda b: b)
    q.awaitTermination()
    got = {r.variant: (r.successes, r.trials) for r in read_snapshot(spark, out).collect()}
    want = {r.variant: (r.successes, r.trials) for r in ab_stats(ab).collect()}
    assert got == want


def test_registered_streams_read_a_table_of_several_files(spark, workdir):
    from bayes_ops.queries import QUERIES

    path = os.path.join(workdir, "events.parquet")
    spark.read.parquet(f"{SF001}/events.parquet").repartitionByRange(4, "ts").write.parquet(path)
    parts = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    assert len(parts) == 4
    for k, f in enumerate(parts):      # the newest events arrive first
        os.utime(os.path.join(path, f), (1_700_000_000 - 100 * k,) * 2)
    rows = lambda name, sf: sorted(map(tuple, QUERIES[name](spark, sf).collect()))
    for name in ("t1_stream_ingest", "t2_stream_poisson_posterior", "t3_stream_window_counts"):
        got = rows(name, workdir)
        assert got and got == rows(name, SF001), name
    batch = windowed_counts(AD.poisson_from_events(spark, workdir), ["cohort"], "1 day")
    assert sum(r[2] for r in rows("t3_stream_window_counts", workdir)) == batch.agg(F.sum("n_events")).first()[0]


def test_key_delivered_again_with_another_time_lands_once(spark, workdir):
    src, sink, ck = (os.path.join(workdir, p) for p in ("src", "sink", "ck"))
    os.makedirs(src)
    for k, day in enumerate((2, 20)):
        row = {"event_id": "e1", "timestamp": f"2024-01-{day:02d} 00:00:00", "cohort": "c0", "event_type": "click"}
        path = os.path.join(src, f"batch-{k}.json")
        with open(path, "w") as f:
            f.write(json.dumps(row) + "\n")
        os.utime(path, (1_700_000_000 + k,) * 2)
    raw = event_stream(spark, src, "poisson-cohorts", key="event_id", max_files_per_trigger=1)
    start_ingest(raw, "poisson-cohorts", sink, ck, key="event_id").awaitTermination()
    assert [str(r.timestamp) for r in read_ingested(spark, sink, "poisson-cohorts").collect()] == ["2024-01-02 00:00:00"]
