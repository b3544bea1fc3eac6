"""Batch validation and append (ops W3, S3, S4, S6).

A batch is split into rows that fit the kind schema and rows rejected with
a reason, in one pass: every check is a Column expression (``try_cast`` so a
bad value becomes a reason instead of a failed job under ANSI mode).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bayes_ops.sources.schemas import POISSON_EXPOSURE_COLUMN, kind_schema, table_schema


class SchemaMismatch(ValueError):
    pass


def check_columns(df: DataFrame, kind: str) -> None:
    """Missing or extra columns reject the whole batch (like a bad request)."""
    want = [f.name for f in kind_schema(kind).fields]
    have = df.columns
    missing = [c for c in want if c not in have]
    extra = [c for c in have if c not in want and not (kind == "poisson-cohorts" and c == POISSON_EXPOSURE_COLUMN)]
    if missing or extra:
        raise SchemaMismatch(f"missing columns {missing}, unexpected columns {extra}")


def _domain(kind: str, with_exposure: bool = False) -> list[tuple[str, Column]]:
    """(reason, failing condition on the cast columns)."""
    checks = []
    if kind == "ab-test":
        checks.append(("outcome_not_binary", ~F.col("outcome").isin(0, 1)))
    if kind in ("weibull", "hazard-rate"):
        checks.append(("negative_duration", F.col("duration") < 0))
        checks.append(("zero_observed_duration", (F.col("duration") == 0) & F.col("observed")))
    if kind == "poisson-cohorts":
        checks.append(("missing_cohort", F.col("cohort").isNull()))
        if with_exposure:
            checks.append(("negative_exposure", F.col(POISSON_EXPOSURE_COLUMN) < 0))
    if "timestamp" in [f.name for f in kind_schema(kind).fields]:
        checks.append(("missing_timestamp", F.col("timestamp").isNull()))
    return checks


def validate(df: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cast to the kind schema and attach ``reject_reason`` (NULL = good).

    Reasons: ``bad_<column>`` when a non-null value does not cast, then the
    kind's domain checks, first failing check wins.  ``keep`` columns (e.g.
    an event key) pass through unchanged.
    """
    check_columns(df.drop(*keep), kind)
    fields = table_schema(kind, df.columns).fields
    cast = [F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields]
    raw = [F.col(f.name).alias(f"_raw_{f.name}") for f in fields]
    t = df.select(*[F.col(k) for k in keep], *cast, *raw)
    reasons = []
    for f in fields:
        reasons.append((f"bad_{f.name}", F.col(f"_raw_{f.name}").isNotNull() & F.col(f.name).isNull()))
    reasons += _domain(kind, POISSON_EXPOSURE_COLUMN in df.columns)
    reason = F.lit(None).cast(T.StringType())
    for name, cond in reversed(reasons):
        reason = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(reason)
    return t.withColumn("reject_reason", reason).drop(*[f"_raw_{f.name}" for f in fields])


def split(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(good rows in the kind schema, rejected rows with reason)."""
    v = validate(df, kind)
    good = v.where(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = v.where(F.col("reject_reason").isNotNull())
    return good, bad


def read_json_batch(spark, path: str) -> DataFrame:
    """JSON array of event objects, all values kept as text for validation (S3)."""
    return (spark.read.option("multiLine", True).option("primitivesAsString", True)
            .option("mode", "PERMISSIVE").json(path))


def read_csv_batch(spark, path: str) -> DataFrame:
    """CSV with a header, all values as text."""
    return spark.read.option("header", True).csv(path)
