"""Small helpers shared by the operators: column checks and scratch names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def need(df: DataFrame, *names: str) -> None:
    """Raise if a column is missing; operators take names, never positions."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; have {df.columns}")


def as_list(value: str | Iterable[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def keep_type(col, df: DataFrame, name: str):
    return col.cast(df.schema[name].dataType)
