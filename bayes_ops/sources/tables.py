"""Readers for experiment tables and Parquet files (ops S1, S2, F8).

JSON and CSV event batches are read by ``sources.ingest`` (S3, S4).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bayes_ops.sources.schemas import kind_schema


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, ``<sf_dir>/<name>.parquet`` (op S2)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of part files, in whatever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Inspect any Parquet file or directory (op S2)."""
    return spark.read.parquet(path)


def read_experiment(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Scan an experiment table stored as Parquet (op S1).

    When ``kind`` is given the columns are projected and cast to the kind
    schema (``try_cast``: values that do not fit become NULL and are counted
    by the models, never raised).
    """
    df = spark.read.parquet(path)
    if kind is None:
        return df
    return conform(df, kind)


def conform(df: DataFrame, kind: str) -> DataFrame:
    """Project and cast a frame to the kind schema (op F8)."""
    cols = []
    existing = set(df.columns)
    for f in kind_schema(kind).fields:
        if f.name in existing:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    # Poisson tables may carry an exposure column (kept when present).
    if kind == "poisson-cohorts" and "exposure" in existing:
        cols.append(F.col("exposure").try_cast("double").alias("exposure"))
    return df.select(*cols)
