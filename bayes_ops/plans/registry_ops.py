"""Read-only previews of table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bayes_ops.sources.registry import delete_condition


def delete_preview(df: DataFrame, filters: dict, start=None, end=None) -> DataFrame:
    """Per cohort: rows a delete would remove and rows that survive (one scan)."""
    cond = F.coalesce(delete_condition(filters, start, end), F.lit(False))
    return df.groupBy("cohort").agg(
        F.sum(F.when(cond, 1).otherwise(0)).cast("long").alias("deleted"),
        F.sum(F.when(cond, 0).otherwise(1)).cast("long").alias("remaining"))
