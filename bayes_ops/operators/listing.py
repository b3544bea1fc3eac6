"""Listing, inspection, ordering and sequence windows.

A page within the first ``SHALLOW`` rows is a bounded top-k.  A deeper one is found by rank: counts of
the rows in ``BUCKETS`` time buckets tell which of them hold the page, the search goes on inside those until few
rows besides the page are left, and only these are sorted.  The last read filters on the timestamp, which
Parquet can skip row groups by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bayes_ops.operators import filters as flt


def deterministic_order(df: DataFrame, first: str | None = "timestamp") -> list:
    """timestamp first, then every other column: a total order (quirk Q7)."""
    cols = ([first] if first and first in df.columns else []) + [c for c in df.columns if c != first]
    return [F.col(c).asc_nulls_first() for c in cols]


SHALLOW = 100_000
BUCKETS = 4096


def page(df: DataFrame, offset: int, limit: int, by: str = "timestamp") -> DataFrame:
    """Rows offset .. offset + limit of the total order (nulls first, then ``by``, then the other columns)."""
    order = deterministic_order(df, by)
    if offset + limit <= SHALLOW or by not in df.columns:
        return df.orderBy(*order).offset(offset).limit(limit)
    at = F.unix_micros(F.col(by).cast("timestamp"))
    kept, skip = df, offset
    ext = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.when(F.col(by).isNull(), 1)).alias("none"),
                 F.count("*").alias("n")).first()
    if skip < ext["none"] or ext["lo"] is None:        # the page starts among the rows without a time
        upto = df.where(F.col(by).isNull()) if skip + limit <= ext["none"] else df
        return upto.orderBy(*order).offset(skip).limit(limit)
    kept, skip, lo, hi, n = df.where(F.col(by).isNotNull()), skip - ext["none"], ext["lo"], ext["hi"], ext["n"]
    while n > SHALLOW and hi > lo:
        width = -(-(hi - lo + 1) // BUCKETS)
        counts = kept.groupBy(F.floor((at - F.lit(lo)) / F.lit(width)).cast("long").alias("b")).count().orderBy("b").collect()
        first, last, before, run = None, None, 0, 0
        for r in counts:                               # at most BUCKETS rows
            if first is None and run + r["count"] > skip:
                first, before = r["b"], run
            run += r["count"]
            if first is not None:
                last, n = r["b"], run - before
                if run >= skip + limit:
                    break
        if first is None:
            return df.limit(0)
        new_lo, new_hi = lo + first * width, min(hi, lo + (last + 1) * width - 1)
        bounds = [F.timestamp_micros(F.lit(v)).cast(df.schema[by].dataType) for v in (new_lo, new_hi)]
        kept, skip = kept.where((F.col(by) >= bounds[0]) & (F.col(by) <= bounds[1])), skip - before
        if (new_lo, new_hi) == (lo, hi):               # one bucket holds all: rows of nearly one time
            break
        lo, hi = new_lo, new_hi
    return kept.orderBy(*order).offset(skip).limit(limit)


def list_events(df: DataFrame, cohort=None, event_type=None, start=None, end=None,
                limit: int = 1000, offset: int = 0) -> DataFrame:
    """Filtered events ordered by timestamp, one page (op L1).

    limit in 1..100000, offset >= 0; see ``page``.
    """
    if not 1 <= limit <= 100000 or offset < 0:
        raise ValueError("limit must be in 1..100000 and offset >= 0")
    preds = (flt.membership("cohort", cohort) + flt.membership("event_type", event_type)
             + flt.time_window(start, end))
    return page(flt.apply(df, preds), offset, limit)


def inspect(df: DataFrame, start=None, end=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of any experiment plus the filtered total (ops L2, A10).

    The time window applies only when the table has a timestamp column.
    """
    if not 1 <= limit <= 10000 or offset < 0:
        raise ValueError("limit must be in 1..10000 and offset >= 0")
    f = flt.window_if_timestamped(df, start, end)
    total = f.agg(F.count(F.lit(1)).alias("total_count")).first()["total_count"]
    return page(f, offset, limit).withColumn("total_count", F.lit(total).cast("long"))


def trial_sequence(df: DataFrame, key: str = "variant", value: str = "outcome") -> DataFrame:
    """Trial index and running successes within each group (op N7), skew-safe.

    A plain window over ``partitionBy(key)`` would sort a whole group in one
    task.  Instead the rows are range-partitioned on (key, order, a row id) --
    the range bounds split a hot group, even one of identical rows, over many
    tasks -- and written once to the shared checkpoint folder, so rows and
    block sizes come from the same partitioning.  Rows are numbered inside
    each (partition, key) block, and each block adds the counts and successes
    of the same key's blocks in earlier partitions (a small table: at most
    #partitions + #keys rows).  A NULL key is a group like any other.
    """
    from bayes_ops.operators.joins import join_groups
    from bayes_ops.operators.materialize import reliable_checkpoint
    order = [c for c in deterministic_order(df.drop(key))]
    ranged = reliable_checkpoint(
        df.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(F.col(key), *order, F.col("_row")).withColumn("_pid", F.spark_partition_id()))
    blk = Window.partitionBy("_pid", key).orderBy(*order, "_row")
    run = blk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (ranged.withColumn("_n", F.row_number().over(blk))
             .withColumn("_s", F.sum(F.col(value).cast("long")).over(run)))
    sizes = ranged.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("b_n"),
                                            F.sum(F.col(value).cast("long")).alias("b_s"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("o_n", F.coalesce(F.sum("b_n").over(before), F.lit(0)))
               .withColumn("o_s", F.coalesce(F.sum("b_s").over(before), F.lit(0)))
               .select("_pid", key, "o_n", "o_s"))
    out = join_groups(local, offsets, ["_pid", key])
    return (out.withColumn("seq", (F.col("o_n") + F.col("_n")).cast("int"))
            .withColumn("cum_successes", (F.col("o_s") + F.col("_s")).cast("long"))
            .drop("_pid", "_row", "_n", "_s", "o_n", "o_s"))


def rank_by(df: DataFrame, cols: Sequence, name: str = "rank") -> DataFrame:
    """Explicit rank column for a sorted listing of groups (ops L3, L4).

    Rows are dealt out by range of the order and numbered inside each range, which adds the
    sizes of the ranges before it, so the sort runs in as many tasks as there are ranges."""
    from bayes_ops.operators.materialize import reliable_checkpoint
    ranged = reliable_checkpoint(df.repartitionByRange(*cols).withColumn("_pid", F.spark_partition_id()))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_size"))
    sizes = sizes.select("_pid", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(*cols))
    return ranged.withColumn("_n", inside).join(sizes, "_pid").withColumn(
        name, (F.col("_n") + F.col("_before")).cast("int")).drop("_pid", "_n", "_before")
