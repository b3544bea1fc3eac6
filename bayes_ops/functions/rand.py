"""Partition-independent reproducible uniforms (used by draws, op C4).

u = (int(first 13 hex digits of md5("seed:group:i")) + 0.5) / 16^13.
A pure function of (seed, group, i): identical under retries, repartitioning
and executor loss, and reproducible in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DENOM = float(16 ** 13)


def hash_uniform(seed: Column, group: Column, i: Column) -> Column:
    h = F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), group.cast("string"),
                                             i.cast("string"))), 1, 13), 16, 10)
    return (h.cast("double") + F.lit(0.5)) / F.lit(_DENOM)
