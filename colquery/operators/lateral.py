"""Correlated subqueries, decorrelated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import _named


def lateral_agg(outer: DataFrame, inner: DataFrame, on: list[tuple[str, str]], **columns) -> DataFrame:
    """For each outer row the aggregates of its inner rows; count columns are 0 where there is none.

    Inner rows are aggregated once per key below the join rather than rescanned.
    """
    keys = [b for _, b in on]
    sums = inner.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*_named(columns))
    cond = None
    for a, b in on:
        c = outer[a] == sums[f"__{b}"]
        cond = c if cond is None else cond & c
    out = outer.join(sums, cond, "left").drop(*[f"__{k}" for k in keys])
    counts = [n for n, c in columns.items() if str(c).strip().lower().startswith("count(")]
    return out.fillna(0, subset=counts) if counts else out


def lateral_limit(outer: DataFrame, inner: DataFrame, on: list[tuple[str, str]], order_by, n: int, offset: int = 0) -> DataFrame:
    """Each outer row with up to ``n`` of its inner rows after ``offset``, in the given order."""
    keys = [b for _, b in on]
    w = Window.partitionBy(*keys).orderBy(*order_by)
    rn = F.row_number().over(w)
    ranked = inner.withColumn("__rn", rn).where((F.col("__rn") > offset) & (F.col("__rn") <= offset + n)).drop("__rn")
    cond = None
    for a, b in on:
        c = outer[a] == ranked[b]
        cond = c if cond is None else cond & c
    return outer.join(ranked, cond)
