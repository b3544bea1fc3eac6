"""Experiment registry and table lifecycle (ops G1-G9, S1, S5-S9).

Layout under a root folder on shared storage:

  <root>/_registry/            append-only Parquet log of registry records
  <root>/<name>/v=<version>/   the experiment's data, one folder per version

The current registry is the latest record per name (``max_by`` on a
sequence number); dropping appends a 'dropped' record.  Rewrites (delete by
filter, column migration) write a new version folder first and append the
pointer record last, so a crash leaves an unreferenced folder, never a
dangling or half-written table.  A single writer per experiment is assumed.
Only Spark reads and appends are used: no renames, so any storage works.
"""

from __future__ import annotations

import datetime as _dt
import functools
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayes_ops.operators.cache import read_or_empty
from bayes_ops.sources.ingest import check_columns, split, validate
from bayes_ops.sources.schemas import SUPPORTED_KINDS, schema_rows

LOG_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("display_name", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("version", T.LongType(), True),
    T.StructField("seq", T.LongType(), False),
])


class ExperimentNotFound(KeyError):
    pass


class WrongKind(ValueError):
    pass


class AlreadyExists(ValueError):
    pass


def _log_path(root: str) -> str:
    return root.rstrip("/") + "/_registry"


def data_path(root: str, name: str, version: int) -> str:
    return f"{root.rstrip('/')}/{name}/v={version}"


def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def _append(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, LOG_SCHEMA).write.mode("append").parquet(_log_path(root))


def init_registry(spark: SparkSession, root: str) -> DataFrame:
    """Create the (empty, typed) registry if absent (G1); returns the kind schemas."""
    log = read_or_empty(spark, _log_path(root), LOG_SCHEMA)
    if log.limit(1).count() == 0:
        spark.createDataFrame([], LOG_SCHEMA).write.mode("append").parquet(_log_path(root))
    return kind_schemas(spark)


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Current registry: latest record per name, dropped names removed."""
    log = read_or_empty(spark, _log_path(root), LOG_SCHEMA)
    latest = log.groupBy("name").agg(F.max_by(F.struct(*[c for c in LOG_SCHEMA.names if c != "name"]),
                                              F.col("seq")).alias("r"))
    cur = latest.select("name", "r.*")
    return cur.where(F.col("status") != "dropped").drop("seq")


def list_experiments(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """name, type, display_name, status, created_at as ISO text."""
    r = registry(spark, root)
    if kind:
        r = r.where(F.col("type") == kind)
    return r.select("name", "type", "display_name", "status",
                    F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"))


def lookup(spark: SparkSession, root: str, name: str, kind: str | None = None):
    """Registry row of an experiment; raises ExperimentNotFound / WrongKind."""
    rows = registry(spark, root).where(F.col("name") == name).limit(1).collect()
    if not rows:
        raise ExperimentNotFound(f"no experiment is registered as '{name}'")
    row = rows[0]
    if kind is not None and row["type"] != kind:
        raise WrongKind(f"'{name}' holds kind '{row['type']}', asked for as '{kind}'")
    return row


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the current experiment tables."""
    return sorted(r["name"] for r in registry(spark, root).select("name").collect())


_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
              "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP",
              "date": "DATE", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def describe(df: DataFrame) -> DataFrame:
    """Column name, SQL type, nullability, position and row count."""
    n = df.count()
    rows = [(f.name, _SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()),
             bool(f.nullable), i, n) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, column_type string, nullable boolean, position int, row_count long")


def kind_schemas(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """Required columns of one or all kinds."""
    return spark.createDataFrame(schema_rows(kind), "experiment_type string, name string, type string, position int")


def read_experiment(spark: SparkSession, root: str, name: str, kind: str | None = None) -> DataFrame:
    """Current version of an experiment table."""
    row = lookup(spark, root, name, kind)
    return spark.read.parquet(data_path(root, name, row["version"]))


def create_experiment(spark: SparkSession, root: str, name: str, kind: str, display_name: str,
                      data: DataFrame) -> int:
    """Validate, write version 1, then register (S5).  Raises AlreadyExists
    (409) or ValueError for an empty or invalid batch (400).  Returns rows."""
    if not registry(spark, root).where(F.col("name") == name).isEmpty():
        raise AlreadyExists(f"'{name}' is registered already")
    version = time.time_ns()
    path = data_path(root, name, version)
    if kind in SUPPORTED_KINDS:
        check_columns(data, kind)
        data = validate(data, kind)
    else:
        data = data.withColumn("reject_reason", F.lit(None).cast("string"))
    # one pass over the source: the counts are observed while the rows are written
    seen = Observation()
    data = data.observe(seen, F.count("*").alias("n"), F.count("reject_reason").alias("bad"))
    data.where("reject_reason is null").drop("reject_reason").write.mode("errorifexists").parquet(path)
    n, n_bad = seen.get["n"], seen.get["bad"]
    if n_bad or not n:
        _remove(spark, path)
        raise ValueError(f"{n_bad} rows do not fit the kind '{kind}'" if n_bad else "the first batch holds no rows")
    _append(spark, root, [(name, kind, display_name, "created", _now(), version, time.time_ns())])
    return n


def append_events(spark: SparkSession, root: str, name: str, batch: DataFrame) -> tuple[int, DataFrame]:
    """Validate a batch and append the good rows.

    Returns (rows appended, rejected rows with reason).  A batch whose
    columns do not match the kind is refused whole (SchemaMismatch).
    """
    row = lookup(spark, root, name)
    kind = row["type"]
    good, bad = split(batch, kind)
    seen = Observation()      # counted while written: the batch is read once, and nothing of it is cached
    good.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(data_path(root, name, row["version"]))
    return seen.get["n"], bad


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _rewrite(spark: SparkSession, root: str, row, new_data: DataFrame) -> None:
    version = time.time_ns()
    new_data.write.mode("errorifexists").parquet(data_path(root, row["name"], version))
    _append(spark, root, [(row["name"], row["type"], row["display_name"], row["status"], row["created_at"],
                           version, time.time_ns())])


def delete_condition(filters: dict, start=None, end=None):
    from bayes_ops.operators import filters as flt
    preds = flt.equalities(filters) + flt.time_window(start, end)
    if not preds:
        raise ValueError("a delete needs a filter or a time window")
    return functools.reduce(lambda a, b: a & b, preds)


def delete_by_filter(spark: SparkSession, root: str, name: str, filters: dict, start=None, end=None) -> int:
    """Delete matching rows; refuses an empty filter set; returns the count.

    Survivors are ``NOT coalesce(cond, false)`` so rows with NULLs in the
    filter columns are kept, as a SQL DELETE would.
    """
    cond = delete_condition(filters, start, end)
    row = lookup(spark, root, name)
    cur = spark.read.parquet(data_path(root, name, row["version"]))
    n = cur.where(cond).count()
    if n:
        _rewrite(spark, root, row, cur.where(~F.coalesce(cond, F.lit(False))))
    return n


def migrate_conversion_column(spark: SparkSession, root: str) -> int:
    """Rename ``conversion`` to ``outcome`` in every bernoulli table that has
    the former and not the latter; returns how many were migrated (G8)."""
    migrated = 0
    for row in registry(spark, root).where(F.col("type") == "bernoulli").collect():
        df = spark.read.parquet(data_path(root, row["name"], row["version"]))
        if "conversion" in df.columns and "outcome" not in df.columns:
            _rewrite(spark, root, row, df.withColumnRenamed("conversion", "outcome"))
            migrated += 1
    return migrated


def drop_experiment(spark: SparkSession, root: str, name: str) -> None:
    """Unregister an experiment and remove all its versions (S7).  The record comes first, so a crash
    between the two leaves an unreferenced folder, which the next drop of the name removes."""
    row = lookup(spark, root, name)
    _append(spark, root, [(name, row["type"], row["display_name"], "dropped", row["created_at"],
                           row["version"], time.time_ns())])
    _remove(spark, f"{root.rstrip('/')}/{name}")


def drop_by_kind(spark: SparkSession, root: str, kind: str) -> list[str]:
    """Drop every experiment of a kind."""
    names = [r["name"] for r in registry(spark, root).where(F.col("type") == kind).select("name").collect()]
    for n in names:
        drop_experiment(spark, root, n)
    return names


def drop_if_exists(spark: SparkSession, root: str, name: str) -> bool:
    """Drop when registered, no error otherwise."""
    try:
        drop_experiment(spark, root, name)
        return True
    except ExperimentNotFound:
        return False
