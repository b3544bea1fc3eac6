"""Time units, parsing and formatting (ops E8, E9, E11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per rate unit.
UNIT_SECONDS = {"second": 1.0, "minute": 60.0, "hour": 3600.0, "day": 86400.0}

# Accepted text timestamp formats (ISO datetime, date, compact date).
TIMESTAMP_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd"]

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def unit_seconds(unit: str) -> float:
    if unit not in UNIT_SECONDS:
        raise ValueError("Unsupported time unit. Use 'second', 'minute', 'hour', or 'day'.")
    return UNIT_SECONDS[unit]


def parse_timestamp(c: Column) -> Column:
    """Unix seconds first (a bare number wins, as in the reference CLI), then
    the text formats, all taken as UTC."""
    as_num = c.try_cast("double")
    unix = F.timestamp_micros((as_num * F.lit(1_000_000.0)).cast("long"))
    parsed = [F.try_to_timestamp(c, F.lit(fmt)) for fmt in TIMESTAMP_FORMATS]
    return F.coalesce(F.when(as_num.isNotNull(), unix), *parsed)


def iso_format(c: Column) -> Column:
    return F.date_format(c, ISO_MICROS)
