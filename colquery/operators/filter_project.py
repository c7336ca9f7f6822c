"""Filters and computed projections."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def filter_rows(df: DataFrame, *conjuncts: Column | str, args: Mapping | None = None) -> DataFrame:
    """Keep rows where every conjunct is true; NULL counts as false.

    ``args`` binds named parameters (``:name``) of string conjuncts as values of
    any type, not as text; a value of None is a NULL, so that a comparison with
    it keeps no row.
    """
    for c in conjuncts:
        if isinstance(c, str) and args:
            plain = c.replace("{", "{{").replace("}", "}}")
            df = df.sparkSession.sql(f"SELECT * FROM {{rows}} WHERE {plain}", args=dict(args), rows=df)
        else:
            df = df.where(c)
    return df


def prepared(df: DataFrame, *conjuncts: str) -> Callable[..., DataFrame]:
    """A filter to be executed with parameters again and again."""
    return lambda **args: filter_rows(df, *conjuncts, args=args)


def create_function(spark: SparkSession, name: str, signature: str, returns: str, body: str) -> None:
    """A user-defined operator as a SQL function, which Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS {returns} RETURN {body}")


def gate(df: DataFrame, condition: bool | None) -> DataFrame:
    """A constant condition before the scan: false or NULL yields no row and reads nothing."""
    return df if condition else df.limit(0)


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Exactly the named expressions; equal ones are computed once by Catalyst."""
    return df.select(*[(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])
