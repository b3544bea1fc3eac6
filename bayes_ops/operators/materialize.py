"""Reliable materialisation of small derived tables.

A sufficient-statistics table referenced several times in one plan would
otherwise re-scan the source once per reference.  ``checkpoint()`` writes it
to the shared folder named by ``spark.checkpoint.dir`` (fault tolerant, cuts
lineage); local checkpoints are never used because they die with an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from bayes_ops.session import checkpoint_dir


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_tasks(df: DataFrame) -> int:
    """Tasks for a checkpointed table of few, costly rows: as many as it has rows, at most the shuffle partitions."""
    return max(1, min(df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Such a table dealt over the tasks (adaptive execution would merge so few bytes into one task)."""
    return df.repartition(spread_tasks(df), *keys)
