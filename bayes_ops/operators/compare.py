"""Decision operators: pairwise P(A > B) and Thompson sampling.

Pairs are given explicitly (e.g. every cohort against a control); the work
per pair grows linearly with the pairs asked for.  P(A > B) = integral of
f_A(x) F_B(x) dx.  A group is one row: its grid's ends and its CDF as an
array.  The cell of B that holds a point is found in closed form, so a pair needs the two rows and
no row per cell.  A group in many pairs (the control) is sent once to each block of
``BLOCK`` of them, so its pairs are spread over the tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bayes_ops.operators.arrays import let, total
from bayes_ops.operators.draws import posterior_draws
from bayes_ops.operators.grid import GRID_N, family_support, grid_posterior
from bayes_ops.operators.materialize import reliable_checkpoint

BLOCK = 64


def prob_greater(params: DataFrame, key: str, pairs: DataFrame, family: str = "gamma",
                 a: str = "alpha", b: str = "beta", n: int = GRID_N) -> DataFrame:
    """P(theta_A > theta_B) for each (group_a, group_b) row of ``pairs`` (op C1).

    Midpoint rule on A's grid: sum_i w_A,i F_B(x_i), with F_B interpolated
    linearly inside B's grid cell (0 below B's grid, 1 above it).
    """
    lo, hi, logp, t = family_support(family, F.col(a), F.col(b))
    grid = grid_posterior(params, [key], lo, hi, logp, n, t)
    rows = grid.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "cdf"))).alias("c"), F.first("g_lo").alias("lo"),
                                 F.first("g_hi").alias("hi"), F.first("g_t").alias("t"))
    rows = reliable_checkpoint(rows.select(F.col(key).alias("k"), F.struct(
        F.transform("c", lambda x: x["cdf"]).alias("cdf"), "lo", "hi", "t").alias("g")))
    pr = reliable_checkpoint(pairs.select("group_a", "group_b").distinct())
    both = _with_group(_with_group(pr, rows, "group_a", "ga"), rows, "group_b", "gb")

    def below(x):
        """F_B(x), linear within B's cell."""
        def inside(k):
            x0, x1 = _edge(F.col("gb"), k / n), _edge(F.col("gb"), (k + 1) / n)
            c0 = F.when(k > 0, F.get(F.col("gb.cdf"), k - 1)).otherwise(F.lit(0.0))
            frac = F.least(F.greatest((x - x0) / (x1 - x0), F.lit(0.0)), F.lit(1.0))
            return F.least(F.lit(1.0), c0 + frac * (F.get(F.col("gb.cdf"), k) - c0))
        cell = F.floor(_place(F.col("gb"), x) * n).cast("int")
        held = let(F.least(F.greatest(cell, F.lit(0)), F.lit(n - 1)), inside)
        return F.when(x < F.col("gb.lo"), F.lit(0.0)).when(x >= F.col("gb.hi"), F.lit(1.0)).otherwise(held)

    def term(i):
        w = F.get(F.col("ga.cdf"), i) - F.when(i > 0, F.get(F.col("ga.cdf"), i - 1)).otherwise(F.lit(0.0))
        return let(_edge(F.col("ga"), (i + F.lit(0.5)) / n), lambda x: w * below(x))
    return both.select("group_a", "group_b", total(F.sequence(F.lit(0), F.lit(n - 1)), term).alias("p_a_gt_b"))


def _edge(g: Column, u: Column) -> Column:
    """x at the grid's place u in (0, 1)."""
    shape = F.when(g["t"] == 1, u * u).when(g["t"] == 2, (F.lit(1.0) - F.cos(F.lit(math.pi) * u)) / 2).otherwise(u)
    return g["lo"] + (g["hi"] - g["lo"]) * shape


def _place(g: Column, x: Column) -> Column:
    """The place u of x: ``_edge`` solved for u."""
    def of(y):
        return F.when(g["t"] == 1, F.sqrt(y)).when(g["t"] == 2, F.acos(F.lit(1.0) - 2.0 * y) / F.lit(math.pi)).otherwise(y)
    return let(F.least(F.greatest((x - g["lo"]) / (g["hi"] - g["lo"]), F.lit(0.0)), F.lit(1.0)), of)


def _with_group(pairs: DataFrame, rows: DataFrame, column: str, name: str) -> DataFrame:
    """``pairs`` with the struct of the group in ``column``; a group is sent once to each block of its pairs."""
    blocks = pairs.groupBy(column).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    sent = rows.join(blocks, rows["k"] == blocks[column]).select(
        "k", F.col("g").alias(name), "_blocks", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    keyed = pairs.join(blocks, column).withColumn("_block", F.pmod(F.xxhash64("group_a", "group_b"), F.col("_blocks")).cast("int"))
    return keyed.join(sent.drop("_blocks"), (keyed[column] == sent["k"]) & (keyed["_block"] == sent["_block"])) \
        .drop("k", "_block", "_blocks")


def against_control(params: DataFrame, key: str, control: str) -> DataFrame:
    """Pairs (group, control) for every other group."""
    return (params.select(F.col(key).alias("group_a")).where(F.col("group_a") != F.lit(control))
            .withColumn("group_b", F.lit(control)))


def thompson(params: DataFrame, n: int = 10000, seed: int = 0) -> DataFrame:
    """Monte Carlo P(best arm) (op C2): n Beta draws per arm sharing draw ids,
    value = p x magnitude (0 for an arm that never paid), per draw the best
    arm (ties to the first arm by name), then counts / n.  Arms never best
    get 0.

    The per-draw argmax is a groupBy on draw_id: n groups of (#arms) rows.
    """
    p = params.withColumn("param", F.lit("p"))
    d = posterior_draws(p, ["arm", "magnitude"], "beta", n=n, seed=seed, label_keys=["arm"])
    d = d.withColumn("reward", F.col("value") * F.coalesce(F.col("magnitude"), F.lit(0.0)))
    best = d.groupBy("draw_id").agg(
        F.min_by("arm", F.struct((-F.col("reward")).alias("nr"), F.col("arm"))).alias("arm"))
    counts = best.groupBy("arm").agg((F.count(F.lit(1)) / F.lit(float(n))).alias("prob_best"))
    return (params.select("arm").join(counts, "arm", "left")
            .fillna({"prob_best": 0.0}))


