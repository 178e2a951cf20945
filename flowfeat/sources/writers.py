"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowfeat.columns import need


def to_parquet(df: DataFrame, path: str) -> None:
    """Replace the table at `path`."""
    df.write.mode("overwrite").parquet(path)


def to_lines(df: DataFrame, path: str, cols: list[str] | None = None, single_file: bool = False) -> None:
    """Comma-separated text of the columns; many files unless one is asked for."""
    cols = cols or df.columns
    need(df, *cols)
    out = df.select(*cols)
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path)
