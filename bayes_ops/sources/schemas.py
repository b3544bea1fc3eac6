"""Typed schemas of the six experiment kinds and of the registry table."""

from __future__ import annotations

from pyspark.sql import types as T

# Experiment kinds and their column layouts (name, type).
KIND_COLUMNS: dict[str, list[tuple[str, T.DataType]]] = {
    "poisson-cohorts": [
        ("timestamp", T.TimestampType()),
        ("cohort", T.StringType()),
        ("event_type", T.StringType()),
    ],
    "ab-test": [
        ("timestamp", T.TimestampType()),
        ("variant", T.StringType()),
        ("outcome", T.LongType()),
    ],
    "bernoulli": [
        ("timestamp", T.TimestampType()),
        ("outcome", T.BooleanType()),
    ],
    "multi-armed-bandits": [
        ("timestamp", T.TimestampType()),
        ("arm", T.StringType()),
        ("reward", T.DoubleType()),
    ],
    "weibull": [
        ("duration", T.DoubleType()),
        ("observed", T.BooleanType()),
    ],
    # Not in the original schema map, but fitted from these two columns.
    "hazard-rate": [
        ("duration", T.DoubleType()),
        ("observed", T.BooleanType()),
    ],
}

SUPPORTED_KINDS = list(KIND_COLUMNS)

# Optional column honoured by the Poisson fit when present.
POISSON_EXPOSURE_COLUMN = "exposure"

REGISTRY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("display_name", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    # version directory holding the current data of the experiment
    T.StructField("version", T.LongType(), True),
])


class UnknownKind(ValueError):
    pass


def kind_schema(kind: str) -> T.StructType:
    if kind not in KIND_COLUMNS:
        raise UnknownKind(f"no column layout is known for kind '{kind}'")
    return T.StructType([T.StructField(n, t, True) for n, t in KIND_COLUMNS[kind]])


def table_schema(kind: str, columns: list[str] | None = None) -> T.StructType:
    """The kind's columns, and its optional ones as far as ``columns`` has them (None: all)."""
    out = kind_schema(kind)
    if kind == "poisson-cohorts" and (columns is None or POISSON_EXPOSURE_COLUMN in columns):
        out = T.StructType([*out.fields, T.StructField(POISSON_EXPOSURE_COLUMN, T.DoubleType(), True)])
    return out


def schema_rows(kind: str | None = None) -> list[tuple[str, str, str, int]]:
    """(kind, column, type, position) for one kind or all kinds (op G7)."""
    kinds = [kind] if kind else SUPPORTED_KINDS
    out = []
    for k in kinds:
        for pos, f in enumerate(kind_schema(k).fields):
            out.append((k, f.name, f.dataType.simpleString(), pos))
    return out
