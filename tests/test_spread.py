"""Operators that were one task: best arm, ranks, deep pages, pairs with a control, timeline, box summary, bandit state."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def _arms(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"arm{i:04d}", float(rng.integers(2, 60)), float(rng.integers(2, 60)), float(rng.integers(1, 4)) if i % 7 else None) for i in range(n)]
    return spark.createDataFrame(rows, "arm string, alpha double, beta double, magnitude double")


def test_best_arm_is_the_same_in_one_range_or_many(spark):
    from bayes_ops.operators.materialize import reliable_checkpoint
    from bayes_ops.plans.bandit import prob_best
    params = reliable_checkpoint(_arms(spark, 40))
    adaptive, parts = (spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = {}
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got[n] = {r["arm"]: r["prob_best"] for r in prob_best(params, n=400).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert sum(got[13].values()) == pytest.approx(1.0, abs=1e-8)
    assert all(got[13][a] == pytest.approx(p, abs=1e-8) for a, p in got[1].items()) and len(got[1]) == 40


def test_ranks_over_ranges(spark):
    from bayes_ops.operators.listing import rank_by
    rng = random.Random(1)
    rows = [(i, rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(9)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")     # else so few rows are one range
        ranked = rank_by(df, [F.col("v").desc(), F.col("id")])
        got = {r["rank"]: r["id"] for r in ranked.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert [got[k + 1] for k in range(3000)] == [i for i, v in sorted(rows, key=lambda r: (-r[1], r[0]))]


@pytest.mark.parametrize("offset", [0, 3, 17, 24, 25, 480, 777, 990, 1010, 1024, 1030, 5000])
def test_deep_pages(spark, monkeypatch, offset):
    """Ties, a time that half of the rows share, rows without a time, pages across them and past the end."""
    from bayes_ops.operators import listing
    monkeypatch.setattr(listing, "SHALLOW", 16)
    monkeypatch.setattr(listing, "BUCKETS", 8)
    rng = random.Random(2)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(None, i) for i in range(25)] + [(t0 + dt.timedelta(days=3), i) for i in range(500)]
    rows += [(t0 + dt.timedelta(microseconds=rng.randrange(10**12)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "timestamp timestamp, id long").repartition(5)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or t0, r[1]))[offset:offset + 20]
    assert [(r["timestamp"], r["id"]) for r in listing.page(df, offset, 20).collect()] == want


def test_deep_page_reads_its_own_time_range(spark, monkeypatch, workdir):
    from bayes_ops.operators import listing
    monkeypatch.setattr(listing, "SHALLOW", 100)
    spark.range(20_000).select(F.timestamp_seconds("id").alias("timestamp"), "id").write.parquet(f"{workdir}/t")
    page = listing.page(spark.read.parquet(f"{workdir}/t"), 10_000, 10)
    assert [r["id"] for r in page.collect()] == list(range(10_000, 10_010))
    pushed = page._sc._jvm.PythonSQLUtils.explainString(page._jdf.queryExecution(), "formatted")
    pushed = [x for x in pushed.splitlines() if x.startswith("PushedFilters")]
    assert pushed and all("GreaterThanOrEqual(timestamp" in x and "LessThanOrEqual(timestamp" in x for x in pushed), pushed


def test_pairs_with_a_control_in_blocks(spark, monkeypatch):
    from bayes_ops.operators import compare
    rng = np.random.default_rng(3)
    rows = [(f"g{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(rng.integers(1, 200, 30), rng.integers(1, 9, 30)))]
    params = spark.createDataFrame(rows, "g string, alpha double, beta double")
    pairs = compare.against_control(params.withColumnRenamed("g", "k"), "k", "g0")
    whole = {r["group_a"]: r["p_a_gt_b"] for r in compare.prob_greater(params, "g", pairs).collect()}
    monkeypatch.setattr(compare, "BLOCK", 3)
    split = {r["group_a"]: r["p_a_gt_b"] for r in compare.prob_greater(params, "g", pairs).collect()}
    assert len(whole) == 29 and whole == pytest.approx(split, abs=1e-12)
    by = dict((g, (a, b)) for g, a, b in rows)
    for g in ("g1", "g2", "g9"):
        draws = rng.gamma(by[g][0], 1 / by[g][1], 400_000) > rng.gamma(by["g0"][0], 1 / by["g0"][1], 400_000)
        assert whole[g] == pytest.approx(draws.mean(), abs=4e-3)


def test_timeline_is_the_kernel_sum(spark):
    from bayes_ops.functions.densities import epanechnikov
    from bayes_ops.operators.views import epanechnikov_timeline
    rng = random.Random(4)
    rows = [("a" if i % 3 else None, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(10**6))) for i in range(400)]
    df = spark.createDataFrame(rows + [("one", dt.datetime(2024, 1, 5))], "c string, timestamp timestamp")
    got = epanechnikov_timeline(df, ["c"], ticks=60)
    ms = df.select("c", F.unix_millis("timestamp").cast("double").alias("v"))
    st = ms.groupBy("c").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"))
    h = F.lit(1.06) * F.coalesce("sd", F.lit(1e-9)) * F.pow(F.col("g.n"), F.lit(-0.2))
    direct = got.alias("g").join(st.alias("s"), F.col("g.c").eqNullSafe(F.col("s.c"))).join(ms.alias("m"), F.col("g.c").eqNullSafe(F.col("m.c")))
    want = {(r["c"], r["j"]): r["k"] for r in direct.groupBy("g.c", "g.j").agg(
        (F.sum(epanechnikov((F.col("tick") - F.col("m.v")) / h, h)) / F.first("s.n")).alias("k")).collect()}
    rows = {(r["c"], r["j"]): r["density"] for r in got.collect()}
    assert rows.keys() == want.keys() and len(rows) == 180
    assert all(rows[k] == pytest.approx(want[k], rel=1e-9, abs=1e-18) for k in rows)


def test_box_summary_of_a_large_group_and_odd_ones(spark):
    from bayes_ops.operators.quantiles import grouped_percentiles
    from bayes_ops.operators.views import box_summary
    big = spark.range(2_000_000).select(F.lit("big").alias("g"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    odd = spark.createDataFrame([(None, 1.0), (None, 2.0), ("one", 5.0), ("none", None), ("ties", 3.0), ("ties", 3.0), ("ties", 4.0)], "g string, v double")
    df = big.unionByName(odd)
    got = {r["g"]: r["q"] for r in grouped_percentiles(df, ["g"], "v", [0.25, 0.5, 0.75]).collect()}
    v = np.array([r["v"] for r in big.select("v").collect()])
    for g, x in (("big", v), (None, [1, 2]), ("one", [5]), ("ties", [3, 3, 4])):
        assert got[g] == pytest.approx(list(np.percentile(x, [25, 50, 75])), rel=1e-15)
    assert "none" not in got
    assert {r["g"] for r in box_summary(df, ["g"], "v").collect()} == {"big", None, "one", "ties"}
    assert grouped_percentiles(odd, [], "v", [0.5]).collect()[0]["q"] == [3.0]


def test_bandit_state_is_one_row_per_arm(spark, workdir):
    """Continuous rewards, maxima that grow between batches, arms that never paid; equal to all pulls at once."""
    from bayes_ops.plans.bandit import bandit_params
    from bayes_ops.streaming.stats import read_snapshot, start_running_bandit
    rng = random.Random(5)
    rows = []
    for k in range(6):
        rows.append([(f"a{rng.randrange(4)}", rng.random() * (k + 1) if rng.random() < 0.5 else float(k // 2)) for _ in range(200)] + [("never", 0.0)])
    shape = "arm string, reward double"
    for part in rows:
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(f"{workdir}/in")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(f"{workdir}/in")
    start_running_bandit(stream, f"{workdir}/out", f"{workdir}/ckpt").awaitTermination()
    every = spark.createDataFrame([r for part in rows for r in part], shape)
    cols = ["arm", "magnitude", "successes", "failures", "alpha", "beta"]
    want = {tuple(r) for r in bandit_params(every.withColumn("timestamp", F.lit(None).cast("timestamp"))).select(*cols).collect()}
    assert {tuple(r) for r in read_snapshot(spark, f"{workdir}/out").select(*cols).collect()} == want and len(want) == 5
    assert spark.read.parquet(f"{workdir}/out/state/5").count() == 5
