"""Cohort preparation (op X3): map stored tables onto experiment kinds.

An adapter is an equality-filter set plus a projection that renames and
casts source columns into a kind schema.  Everything stays lazy, so Catalyst
prunes the scan to the referenced columns and pushes the filters into it.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bayes_ops.sources.tables import read_table


def prepare_cohort(df: DataFrame, filters: Mapping[str, object] | None,
                   columns: Mapping[str, Column]) -> DataFrame:
    """Equality filters (ANDed) then ``select(expr.alias(name))``."""
    if filters:
        cond = functools.reduce(lambda a, b: a & b,
                                [F.col(k) == F.lit(v) for k, v in filters.items()])
        df = df.where(cond)
    return df.select(*[c.alias(n) for n, c in columns.items()])


def utc_ts(col: str) -> Column:
    """Naive parquet timestamps (read as TIMESTAMP_NTZ) -> TIMESTAMP in UTC."""
    return F.col(col).cast("timestamp")


def poisson_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return prepare_cohort(ev, None, {
        "timestamp": utc_ts("ts"),
        "cohort": F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")),
        "event_type": F.col("event_type"),
    })


def ab_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return prepare_cohort(o, None, {
        "timestamp": utc_ts("o_orderdate"),
        "variant": F.col("o_orderpriority"),
        "outcome": (F.col("o_orderstatus") == "F").cast("long"),
    })


def bernoulli_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return prepare_cohort(ev, None, {
        "timestamp": utc_ts("ts"),
        "outcome": F.col("event_type") == "purchase",
    })


def bernoulli_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = read_table(spark, sf_dir, "labels")
    return prepare_cohort(lb, None, {
        "timestamp": F.lit(None).cast("timestamp"),
        "outcome": F.col("quality") == 1,
    })


def brand_magnitude(brand: Column) -> Column:
    """Payout of a brand: 5.0 + 2.5 * (brand number mod 3)."""
    return F.lit(5.0) + F.lit(2.5) * (F.substring(brand, 7, 10).cast("int") % 3)


def bandit_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # Plain equi-join: AQE broadcasts `part` only when its measured size is
    # under spark.sql.autoBroadcastJoinThreshold, else sort-merge (with skew
    # splitting for hot part keys).
    joined = li.join(part, li.l_partkey == part.p_partkey, "inner")
    return prepare_cohort(joined, None, {
        "timestamp": utc_ts("l_shipdate"),
        "arm": F.col("p_brand"),
        "reward": F.when(F.col("l_returnflag") == "R", brand_magnitude(F.col("p_brand")))
                   .otherwise(F.lit(0.0)),
    })


def bandit_histogram_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, reward, cnt) histogram of the bandit table, aggregated before the join.

    The bandit model needs only (arm, reward) counts, and reward depends on
    (part, returned) alone: lineitem is reduced to one row per (part key,
    returned) map-side first, so the join with ``part`` moves at most two rows
    per part instead of every line item (a hot part key collapses in the
    partial aggregate).  Equal to ``reward_histogram(bandit_from_lineitem)``.
    """
    li = (read_table(spark, sf_dir, "lineitem")
          .select("l_partkey", (F.col("l_returnflag") == "R").alias("is_r"))
          .groupBy("l_partkey", "is_r").agg(F.count(F.lit(1)).alias("cnt")))
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(part, li.l_partkey == part.p_partkey, "inner")
    reward = F.when(F.col("is_r"), brand_magnitude(F.col("p_brand"))).otherwise(F.lit(0.0))
    return (j.select(F.col("p_brand").alias("arm"), reward.alias("reward"), "cnt")
            .where(F.col("arm").isNotNull())
            .groupBy("arm", "reward").agg(F.sum("cnt").cast("long").alias("cnt")))


def survival_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return prepare_cohort(li, None, {
        "duration": F.col("l_quantity").cast("double"),
        "observed": F.col("l_returnflag") != "N",
    })


ADAPTERS = {
    "poisson-cohorts": poisson_from_events,
    "ab-test": ab_from_orders,
    "bernoulli": bernoulli_from_events,
    "multi-armed-bandits": bandit_from_lineitem,
    "weibull": survival_from_lineitem,
    "hazard-rate": survival_from_lineitem,
}


def experiment_frame(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return ADAPTERS[kind](spark, sf_dir)
