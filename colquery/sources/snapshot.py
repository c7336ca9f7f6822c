"""Columnar snapshots with storage groups.

A snapshot is Parquet data with a ``__group`` column plus a manifest with one
row per (group, column): null count, min, max and the exact value set where it
has at most 16 members. It is a copy: later changes of the table don't show.

Three ways to read: ``batch`` (no source filtering), ``prune`` (skip groups by
min/max and by the value set; Spark rechecks rows) and ``filter`` (prune, and
filter exactly while reading, arithmetic filters included; nothing is rechecked).
``read_table`` reads a base table or its snapshot, as the switches say.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..plans.config import EngineConfig
from ..session import materialize, ship_package
from .predicates import EXACT, classify, predicate_text
from .snapshot_reader import load

SET_LIMIT = 16
BATCH = 64
#: A predicate is (column, operator, int or None); other filters are SQL text.
OPS = ("=", "<>", "<", "<=", ">", ">=")


def numbered(spark: SparkSession, df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Adds ``__row``, the 0-based rank in ``order_by`` (none: in any order), without a one-task window.

    Rows are range partitioned and sorted; the few partition counts are summed
    up and added to each row's place in its partition.
    """
    ranged = materialize(spark, (df.repartitionByRange(*order_by).sortWithinPartitions(*order_by) if order_by else df)
                         .withColumn("__id", F.monotonically_increasing_id())
                         .withColumn("__part", F.shiftright("__id", 33))
                         .withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id"), "ranged")
    sizes = ranged.groupBy("__part").count()
    starts = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__start"))
    return ranged.join(F.broadcast(starts), "__part").withColumn("__row", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def write_snapshot(df: DataFrame, path: str, group_rows: int = 4096, order_by: Sequence[str] = ()) -> int:
    """Write data and manifest under ``path``; returns the number of groups."""
    spark = df.sparkSession
    if group_rows < BATCH or group_rows % BATCH:
        raise ValueError(f"group_rows must be a positive multiple of {BATCH}")
    if not df.columns:
        raise ValueError("a snapshot needs at least one column")
    for f in df.schema:
        if not isinstance(f.dataType, IntegerType):
            raise ValueError(f'column "{f.name}" is not int')
    order = list(order_by) or df.columns
    grouped = numbered(spark, df, order).withColumn("__group", F.floor(F.col("__row") / group_rows).cast("long"))
    grouped.repartitionByRange("__group").sortWithinPartitions("__row").write.parquet(f"{path}/data")
    data = spark.read.parquet(f"{path}/data")
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    cells = data.select("__group", F.expr(f"stack({len(df.columns)}, {stack}) AS (col, v)"))
    values = F.sort_array(F.collect_set("v"))  # of one group, so of group_rows values at most
    (cells.groupBy("__group", "col")
     .agg(F.count("*").alias("n_rows"), F.count("v").alias("n_values"), F.min("v").alias("min"), F.max("v").alias("max"), values.alias("vs"))
     .withColumn("values", F.when(F.size("vs") <= SET_LIMIT, F.col("vs"))).drop("vs")
     .write.parquet(f"{path}/manifest"))
    return spark.read.parquet(f"{path}/manifest").agg(F.countDistinct("__group")).first()[0]


def _verdicts(predicates) -> list[tuple[str, str]]:
    """Per predicate its column and the SQL of: skipped by min/max, skipped by the value set."""
    out = []
    for col, op, v in predicates:
        if op not in OPS:
            raise ValueError(f"unknown operator {op}")
        if v is None:
            out.append((col, "true", "false"))
            continue
        v = int(v)
        miss = {"=": f"{v} < min OR {v} > max", "<>": f"min = {v} AND max = {v}", "<": f"min >= {v}", "<=": f"min > {v}", ">": f"max <= {v}", ">=": f"max < {v}"}[op]
        member = f"values IS NOT NULL AND NOT array_contains(values, {v})" if op == "=" else "false"
        out.append((col, f"n_values = 0 OR ({miss})", member))
    return out


def _judged(spark: SparkSession, path: str, predicates) -> DataFrame:
    """Per group whether min/max, else the value set, rules it out."""
    manifest = spark.read.parquet(f"{path}/manifest")
    by_range, by_set = F.lit(False), F.lit(False)
    for col, miss, member in _verdicts(predicates):
        here = F.col("col") == col
        by_range = by_range | (here & F.coalesce(F.expr(miss), F.lit(False)))
        by_set = by_set | (here & F.coalesce(F.expr(member), F.lit(False)))
    return manifest.groupBy("__group").agg(F.max(by_range).alias("by_range"), F.max(by_set).alias("by_set"), F.max("n_rows").alias("n_rows"))


#: Up to this many surviving groups become a predicate on the scan; beyond it they are joined.
INLINE_GROUPS = 2048


def compress(df: DataFrame, path: str, group_rows: int = 4096, order_by: Sequence[str] = ()) -> int:
    """The snapshot sink: writes as ``write_snapshot`` does and returns the bytes written."""
    write_snapshot(df, path, group_rows, order_by)
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def read_snapshot(spark: SparkSession, path: str, predicates=(), *, mode: str | None = None, filters: Sequence[str] = (), columns: Sequence[str] = (), config: EngineConfig | None = None) -> DataFrame:
    """``predicates`` are (column, operator, int or None), ``filters`` SQL text; ``mode`` defaults to the switch of ``config``."""
    mode = mode or (config or EngineConfig()).snapshot_mode
    if mode not in ("batch", "prune", "filter"):
        raise ValueError(f"unknown snapshot mode {mode}")
    df = spark.read.parquet(f"{path}/data")
    known = [c for c in df.columns if not c.startswith("__")]
    wanted = list(columns) or known
    few = None
    if mode != "batch" and predicates:
        live = _judged(spark, path, predicates).where("NOT by_range AND NOT by_set").select("__group")
        few = [r[0] for r in live.limit(INLINE_GROUPS + 1).collect()]
        if not few or any(v is None for _, _, v in predicates):
            return df.select(*wanted).limit(0)
        if len(few) > INLINE_GROUPS:
            few = None
            df = df.join(live, "__group", "left_semi")
        else:
            df = df.where(F.col("__group").isin(few))
    exact = [predicate_text(p) for p in predicates if p[2] is not None and classify(mode, known, predicate=p) == EXACT]
    exact += [t for t in filters if classify(mode, known, text=t) == EXACT]
    if exact:
        needed = [*wanted, *(c for c in known if c not in wanted)] if len(exact) < len(predicates) + len(filters) else wanted
        ship_package(spark)
        df = load(spark, path, needed, exact, few)
    for p in predicates:  # what the source left: the executor's recheck
        if p[2] is None:
            df = df.where(F.lit(None).cast("boolean"))
        elif predicate_text(p) not in exact:
            df = df.where(F.expr(f"`{p[0]}` {p[1]} {int(p[2])}"))
    for text in filters:
        if text not in exact:
            df = df.where(text)
    return df.select(*wanted)


def read_table(base: DataFrame, path: str | None, predicates=(), *, filters: Sequence[str] = (), config: EngineConfig | None = None) -> DataFrame:
    """Rows of ``base`` that pass, from its snapshot where there is one and the switches allow it. The base table stays as it is."""
    config = config or EngineConfig()
    if path and config.enable and config.snapshot_enable:
        return read_snapshot(base.sparkSession, path, predicates, filters=filters, columns=base.columns, config=config)
    for col, op, v in predicates:
        base = base.where(F.lit(None).cast("boolean") if v is None else F.expr(f"`{col}` {op} {int(v)}"))
    for text in filters:
        base = base.where(text)
    return base


def prune_stats(spark: SparkSession, path: str, predicates) -> DataFrame:
    """One row: groups examined, skipped by min/max, skipped by value set, rows of the rest, rows the filter removed."""
    judged = _judged(spark, path, predicates)
    counts = judged.agg(F.count("*").alias("groups_examined"), F.count_if("by_range").alias("skipped_min_max"),
                        F.count_if(F.expr("NOT by_range AND by_set")).alias("skipped_membership"),
                        F.coalesce(F.sum(F.when(~F.col("by_range") & ~F.col("by_set"), F.col("n_rows"))), F.lit(0)).alias("rows_read"))
    kept = read_snapshot(spark, path, predicates, mode="prune").agg(F.count("*").alias("rows_out"))
    total = judged.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"))
    return counts.crossJoin(kept).crossJoin(total).select(*counts.columns, "rows_out", (F.col("n") - F.col("rows_out")).alias("rows_removed"))


def encoding_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per column how many 64-row batches would be stored as DELTA8, DELTA16 or PLAIN.

    A NULL repeats the last value; a batch takes the narrowest signed delta
    that holds every step between neighbours.
    """
    df = spark.read.parquet(f"{path}/data")
    cols = [c for c in df.columns if not c.startswith("__")]
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    cells = df.select("__row", F.expr(f"stack({len(cols)}, {stack}) AS (col, v)")).withColumn("batch", F.floor(F.col("__row") / BATCH))
    w = Window.partitionBy("col", "batch").orderBy("__row")
    filled = cells.withColumn("x", F.coalesce(F.last("v", True).over(w), F.lit(0)).cast("long"))
    step = F.col("x") - F.lag("x").over(w)
    widest = filled.withColumn("d", step).groupBy("col", "batch").agg(F.coalesce(F.min("d"), F.lit(0)).alias("lo"), F.coalesce(F.max("d"), F.lit(0)).alias("hi"))
    kind = (F.when((F.col("lo") >= -128) & (F.col("hi") <= 127), "DELTA8")
            .when((F.col("lo") >= -32768) & (F.col("hi") <= 32767), "DELTA16").otherwise("PLAIN"))
    return widest.groupBy("col", kind.alias("encoding")).agg(F.count("*").alias("batches"))
