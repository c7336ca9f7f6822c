"""LIMIT, OFFSET and WITH TIES with their edge cases."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which LIMIT and OFFSET are left to Spark, which brings all rows up to their end, or beyond OFFSET, into one task.
MAX_ONE_TASK = 100_000
INT8_MAX = 2**63 - 1


def limit_offset(df: DataFrame, n: int | None = None, offset: int | None = None, order_by=None) -> DataFrame:
    """NULL limit: none. NULL offset: 0. Negative: an error. Both may be any int8.

    A LIMIT whose end is near is a top-k. Anything else is cut by the rows'
    numbers, which are found by a range sort and partition totals, and sorted
    again in as many tasks as it takes. ``order_by`` should be a unique key.
    """
    if n is not None and n < 0:
        raise ValueError("LIMIT must not be negative")
    if offset is not None and offset < 0:
        raise ValueError("OFFSET must not be negative")
    keys = [] if order_by is None else [order_by] if isinstance(order_by, str) else list(order_by)
    offset = offset or 0
    end = INT8_MAX if n is None else min(offset + n, INT8_MAX)
    if n == 0:
        return df.limit(0)
    if end > MAX_ONE_TASK and (offset or end < INT8_MAX):
        try:
            return _cut(df, offset, end, keys)
        except AnalysisException:  # holds what Parquet cannot, and errors of df itself, which are raised again
            pass
    if keys:
        df = df.orderBy(*keys)
    if offset:
        df = df.offset(offset)
    return df if end == INT8_MAX else df.limit(n)


def _cut(df: DataFrame, offset: int, end: int, keys: list) -> DataFrame:
    """Rows ``offset`` to ``end`` by number. They are written under names of their own, as those of ``df`` may repeat or be ``__row``."""
    from ..sources.snapshot import numbered

    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    rows = numbered(df.sparkSession, ranged.toDF(*(f"c{i}" for i in range(len(df.columns)))), ())
    rows = rows.where((F.col("__row") >= offset) & (F.col("__row") < end))
    return (rows.orderBy("__row") if keys else rows).drop("__row").toDF(*df.columns)


def with_ties(df: DataFrame, n: int, order_by) -> DataFrame:
    """The first ``n`` rows and all that tie with the last of them.

    The n-th key is found by ``limit_offset`` (no global window), then rows up to it are
    filtered; several order columns compare as a struct.
    """
    if n < 0:
        raise ValueError("LIMIT must not be negative")
    if n == 0:
        return df.limit(0)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    key = F.struct(*[F.col(k).isNull().alias(f"n{i}") if j == 0 else F.col(k).alias(f"k{i}") for i, k in enumerate(keys) for j in (0, 1)])
    top = limit_offset(df.select(key.alias("__k")), n, order_by="__k").agg(F.max("__k").alias("__last"))
    return df.join(F.broadcast(top), key <= F.col("__last")).drop("__last")

