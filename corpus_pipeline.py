"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame that is written as Parquet and read again. All but the
last return the columns of ``documents``, further columns included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colquery.catalog import table
from colquery.llm import mixing, packing, quality_gam, shingle_join, toxicity
from colquery.llm.common import materialize
from colquery.llm.queries import pack_tokenizer
from colquery.session import discard, scratch

MIN_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score MIN_QUALITY or more; null and empty texts are scored too."""
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"), label_col="quality")
    return _scored(docs, lambda d, keep: quality_gam.score(d, model, id_col="__doc", text_col="__text", keep=keep), F.col("score") >= MIN_QUALITY)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain's last classifier finds clean."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, lambda d, keep: toxicity.score(d, chain, id_col="__doc", text_col="__text", keep=keep), F.col("toxic") == 0)


def _scored(docs: DataFrame, score, keep_if) -> DataFrame:
    """Rows of ``docs`` pass through the scorer under names that clash with none of its own."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("__text"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return score(renamed, tuple(names.values())).where(keep_if).select(*[F.col(n).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id."""
    return shingle_join.one_per_group(spark, docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by target weight: documents repeat or drop out, by systematic sampling."""
    return mixing.mix_documents(spark, docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    out = packing.pack_documents(spark, docs, pack_tokenizer(), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Fitted classifiers and packing aren't expressible in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row; what a stage wrote is deleted once the next one's table is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as made:
            done = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
            made.keep(done)
        if before is not None:
            discard(spark, before)
        docs = before = done
    return docs
