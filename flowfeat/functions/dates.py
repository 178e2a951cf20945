"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_timestamp(text) -> Column:
    return F.to_timestamp(_c(text), TIMESTAMP_FORMAT)


def hour_of(ts) -> Column:
    return F.hour(_c(ts))


def awake_flag(hour) -> Column:
    """1 for hours 6 … 23, else 0."""
    return _c(hour).between(6, 23).cast("int")


def day_of_week(ts) -> Column:
    """ISO day of week, Monday = 1."""
    return F.weekday(_c(ts)) + 1


def date_to_int(text) -> Column:
    """`MM/dd/yyyy…` to the whole number yyyymmdd, from the first ten characters only."""
    parts = F.split(F.substring(_c(text), 1, 10), "/")

    def number(i: int) -> Column:
        return F.get(parts, F.lit(i)).cast("int")

    return number(2) * 10000 + number(0) * 100 + number(1)
