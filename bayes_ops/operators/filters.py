"""Predicates on experiment tables (ops F1-F8).

All predicates are plain Column expressions; combined with ``where`` they
reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

import datetime as _dt
import functools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ts_lit(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.lit(v).cast("timestamp")
    if isinstance(v, _dt.datetime) and v.tzinfo is not None:
        v = v.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    return F.lit(v).cast("timestamp")


def time_window(start=None, end=None, col: str = "timestamp") -> list[Column]:
    """Half-open ``[start, end)``; each bound optional (op F2)."""
    preds = []
    if start is not None:
        preds.append(F.col(col) >= _ts_lit(start))
    if end is not None:
        preds.append(F.col(col) < _ts_lit(end))
    return preds


def membership(col: str, values: Iterable | None) -> list[Column]:
    """``col IN (values)`` when values are given (op F3)."""
    if not values:
        return []
    return [F.col(col).isin(list(values))]


def equalities(eq: Mapping[str, object]) -> list[Column]:
    """``col = value`` for each non-None entry (op F4)."""
    return [F.col(k) == F.lit(v) for k, v in eq.items() if v is not None]


def conjoin(preds: Sequence[Column]) -> Column | None:
    """AND of optional predicates, None when empty (op F5)."""
    preds = [p for p in preds if p is not None]
    if not preds:
        return None
    return functools.reduce(lambda a, b: a & b, preds)


def apply(df: DataFrame, preds: Sequence[Column]) -> DataFrame:
    cond = conjoin(preds)
    return df if cond is None else df.where(cond)


def window_if_timestamped(df: DataFrame, start=None, end=None) -> DataFrame:
    """F2 applied only when the table has a ``timestamp`` column."""
    if "timestamp" not in df.columns:
        return df
    return apply(df, time_window(start, end))


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Model columns only (op F1); Catalyst prunes the scan to them."""
    return df.select(*cols)


def positive(col: str = "reward") -> Column:
    """Positive-reward predicate (op F6)."""
    return F.col(col) > 0


def observed_flag(col: str = "observed") -> Column:
    """Observed (1) / censored (0) as an integer (op F7)."""
    return F.col(col).cast("int")
