"""Multiset operations."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def not_exists(a: DataFrame, b: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    cond = None
    for x, y in on:
        c = a[x] == b[y]
        cond = c if cond is None else cond & c
    return a.join(b, cond, "left_anti")
