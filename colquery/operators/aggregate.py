"""Global and grouped aggregates: partial below the shuffle, final above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(columns: dict[str, Column | str]) -> list[Column]:
    return [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]


def aggregate(df: DataFrame, **columns: Column | str) -> DataFrame:
    """One row, on empty input too."""
    return df.agg(*_named(columns))


def group_aggregate(df: DataFrame, keys: list[str] | str, *, having: str | None = None, hide_keys: bool = False,
                    rollup: bool = False, cube: bool = False, sets: list[list[str]] | None = None, **columns: Column | str) -> DataFrame:
    """Group by ``keys`` (NULL keys form one group); ``hide_keys`` leaves them out of the result.

    ``rollup``, ``cube`` and ``sets`` (grouping sets, lists of keys) group more than once.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if sets is not None:
        grouped = df.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    else:
        grouped = df.rollup(*keys) if rollup else df.cube(*keys) if cube else df.groupBy(*keys)
    out = grouped.agg(*_named(columns))
    if having:
        out = out.where(having)
    return out.select(*columns) if hide_keys else out
