"""Tables of a data folder as DataFrames or temp views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def create_table_as(df: DataFrame, name: str) -> DataFrame:
    """CREATE TEMP TABLE ... AS: the rows are written once to the shared folder and named as a view of the session."""
    out = materialize(df.sparkSession, df, name)
    out.createOrReplaceTempView(name)
    return out
