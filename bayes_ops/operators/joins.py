"""Equi-joins that keep NULL groups."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the key columns come from ``left``.

    ``<=>`` is an equi-join key for Spark, so this is still a hash or merge join.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("no join keys")
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = functools.reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])
