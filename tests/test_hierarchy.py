"""Quadrature of pooled groups in arrays: chunks, spread, accuracy of the array summaries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bayes_ops.operators import arrays, hierarchy


def _stats(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("g" if i % 3 else None, f"u{i}", int(k), 4.0) for i, k in enumerate(rng.poisson(rng.gamma(3.0, 2.0, n) * 4))]
    return spark.createDataFrame(rows, "g string, unit string, k long, T double")


def test_groups_of_many_chunks_give_the_same(spark, monkeypatch):
    from bayes_ops.plans.hier_poisson import pooled_rates
    stats = _stats(spark, 30)
    whole = {(r["g"], r["unit"]): r for r in pooled_rates(stats).collect()}
    monkeypatch.setattr(hierarchy, "CHUNK", 4)
    split = {(r["g"], r["unit"]): r for r in pooled_rates(stats).collect()}
    assert whole.keys() == split.keys() and len(whole) == 30
    for k, r in whole.items():
        for c in ("mean", "sd", "median", "hdi_3", "hdi_97"):
            assert split[k][c] == pytest.approx(r[c], rel=1e-9)


def test_no_row_per_unit_and_node(spark):
    """Units of a group that fits one chunk are never exploded: its node sums stay in one row."""
    from bayes_ops.plans.hier_poisson import MODEL
    units = _stats(spark, 12).select("g", "unit", F.col("k").cast("double").alias("k"), F.col("T").alias("t"))
    chunks = hierarchy.chunks_of(units, ["k", "t"])
    assert chunks.count() == 2 and {r["parts"] for r in chunks.collect()} == {1}
    groups = units.groupBy("g").agg(*MODEL.consts()).withColumn("lo", F.lit(0.0)).withColumn("hi", F.lit(3.0)).withColumn("n", F.lit(4))
    rows = hierarchy._rows(chunks, groups, MODEL, 0.3)
    assert rows.count() == 2 and all(len(r["rows"]) == 4 for r in rows.collect())
    nodes = hierarchy._weights(chunks, rows, MODEL).collect()
    assert len(nodes) == 2 and all(math.isclose(sum(n["w"] for n in r["nodes"]), 1.0, rel_tol=1e-12) for r in nodes)


def test_array_summaries_of_a_normal_density(spark):
    """Median and HDI of 200 cells of a normal are right to 3e-4 sd, though a cell is 0.08 sd."""
    n, lo, hi = 200, -7.3, 8.9
    x = [lo + (i + 0.5) * (hi - lo) / n for i in range(n)]
    df = spark.createDataFrame([([math.exp(-v * v / 2) for v in x],)], "f array<double>").withColumn("cdf", arrays.edge_cdf(F.col("f")))
    r = df.select(arrays.quantile_at(F.col("cdf"), F.lit(0.5)).alias("m"), arrays.narrowest(F.col("f"), F.col("cdf")).alias("h")).first()
    at = lambda u: lo + u * (hi - lo) / n
    assert at(r["m"]) == pytest.approx(0.0, abs=1e-4)
    assert at(r["h"][0]) == pytest.approx(-1.880794, abs=3e-4) and at(r["h"][1]) == pytest.approx(1.880794, abs=3e-4)


def test_array_summary_of_a_falling_density(spark):
    """The narrowest interval of an exponential starts at its edge."""
    n = 1000
    df = spark.createDataFrame([([math.exp(-(i + 0.5) * 12 / n) for i in range(n)],)], "f array<double>").withColumn(
        "cdf", arrays.edge_cdf(F.col("f")))
    h = df.select(arrays.narrowest(F.col("f"), F.col("cdf")).alias("h")).first()["h"]
    assert h[0] * 12 / n == pytest.approx(0.0, abs=1e-6) and h[1] * 12 / n == pytest.approx(-math.log(0.06), abs=2e-3)


def test_weights_of_far_log_densities(spark):
    df = spark.createDataFrame([([-5000.0, -5001.0, 1.6e10, 1.6e10 - 1],), ([-1e7],)], "v array<double>")
    got = [r["w"] for r in df.select(arrays.normalised(F.col("v"), lambda x: x, lambda x, w: w).alias("w")).collect()]
    share = 1 / (1 + math.exp(-1))
    assert got[0] == pytest.approx([0, 0, share, 1 - share]) and got[1] == [1.0]
