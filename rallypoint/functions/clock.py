"""Times as whole numbers, whatever the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(rows: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without zone is read as UTC."""
    if dict(rows.dtypes)[name] == "timestamp":
        return F.unix_micros(name)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name).cast("timestamp_ntz"))


def seconds(rows: DataFrame, name: str) -> Column:
    return F.floor(micros(rows, name) / 1_000_000)
