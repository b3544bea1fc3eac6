"""Exact percentiles without gathering a column into one task (op A9).

Spark's ``percentile`` keeps one count per distinct value in a single final
buffer.  Here the (value, count) histogram is range-partitioned on the value
(the range bounds spread it evenly over tasks), running counts are taken
inside each partition, each partition adds the counts of all partitions
before it (one number per partition, i.e. per task), and only the <= 2 rows per
requested rank survive the final filter.  Interpolation follows numpy's
default: position h = (n - 1) p, value = v[floor h] + (h - floor h)(v[ceil h] - v[floor h]).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_percentiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """Percentiles of the non-null values of ``col`` (numpy 'linear' rule)."""
    probs = list(probs)
    if not probs:
        return []
    hist = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v"))
            .agg(F.count(F.lit(1)).alias("c")))
    ranged = hist.repartitionByRange("v").withColumn("_pid", F.spark_partition_id())
    inside = Window.partitionBy("_pid").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from bayes_ops.operators.materialize import reliable_checkpoint
    # materialised once (shared folder): the two small actions below reuse it
    local = reliable_checkpoint(ranged.withColumn("cum_local", F.sum("c").over(inside)))
    sizes = local.groupBy("_pid").agg(F.sum("c").alias("p_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = [(r["_pid"], r["off"], r["p_n"]) for r in
               sizes.withColumn("off", F.coalesce(F.sum("p_n").over(before), F.lit(0))).collect()]
    total = sum(n for _, _, n in offsets)
    if not total:
        return [None] * len(probs)
    positions = {}
    for p in probs:
        h = (total - 1) * p
        lo = int(h // 1)
        positions[p] = (h, lo, min(lo + 1, total - 1))
    wanted = sorted({i for _, lo, hi in positions.values() for i in (lo, hi)})
    off = df.sparkSession.createDataFrame([(pid, int(o)) for pid, o, _ in offsets], "_pid int, _off long")
    pos = local.join(off, "_pid").withColumn("end", F.col("_off") + F.col("cum_local")) \
        .withColumn("start", F.col("end") - F.col("c"))  # rows [start, end) hold value v (0-based ranks)
    cond = None
    for i in wanted:
        c = (F.col("start") <= F.lit(i)) & (F.lit(i) < F.col("end"))
        cond = c if cond is None else (cond | c)
    rows = pos.where(cond).select("v", "start", "end").collect()  # at most 2 per requested rank
    at = {}
    for i in wanted:
        for r in rows:
            if r["start"] <= i < r["end"]:
                at[i] = r["v"]
    out = []
    for p in probs:
        h, lo, hi = positions[p]
        a, b = at[lo], at[hi]
        out.append(a + (h - lo) * (b - a))
    return out


def grouped_percentiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float]) -> DataFrame:
    """(keys, q): exact percentiles of every group (numpy 'linear' rule), as an array in the order of ``probs``.

    The (keys, value, count) histogram is dealt out by range of (keys, value), so the bounds split a large
    group over many tasks; each (partition, group) block adds the counts of the group's blocks before it, and
    only the rows that hold a wanted rank (two per percentile) are kept.  No buffer holds a group."""
    from bayes_ops.operators.joins import join_groups
    from bayes_ops.operators.materialize import reliable_checkpoint
    keys, probs = list(keys), list(probs)
    hist = (df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    ranged = reliable_checkpoint(hist.repartitionByRange(*keys, "_v").withColumn("_pid", F.spark_partition_id()))
    blocks = ranged.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_size"))
    by_group = Window.partitionBy(*keys).orderBy("_pid") if keys else Window.orderBy("_pid")   # one row per partition
    whole = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    blocks = blocks.select(*keys, "_pid", F.sum("_size").over(whole).alias("_n"), F.coalesce(
        F.sum("_size").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_pid", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_cum", F.sum("_c").over(inside))
    rows = join_groups(local, blocks, ["_pid", *keys])
    end = F.col("_before") + F.col("_cum")
    start = end - F.col("_c")
    ranks = F.array(*[F.struct(F.lit(k).alias("p"), r.cast("long").alias("r"), side.alias("w")) for k, p in enumerate(probs)
                      for h in [(F.col("_n") - 1) * F.lit(float(p))]
                      for r, side in ((F.floor(h), 1.0 - (h - F.floor(h))), (F.floor(h) + 1, h - F.floor(h)))])
    held = rows.select(*keys, "_v", F.explode(F.filter(ranks, lambda x: (x["w"] > 0) & (x["r"] >= start) & (x["r"] < end))).alias("x"))
    each = held.groupBy(*keys, F.col("x.p").alias("p")).agg(
        F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.min_by("x.w", "x.r").alias("w"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (1.0 - F.col("w")) * (F.col("hi") - F.col("lo")))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", value.alias("q")))), lambda x: x["q"]).alias("q"))
