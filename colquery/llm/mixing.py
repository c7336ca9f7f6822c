"""Mixing sources to target weights by systematic sampling. DataFrame operations only.

Per source a target size is set: sources share ``factor`` times all sizes by
weight, a target stops at ``cap`` times its source's size, and the excess is
shared again among the others. With ratio = target / size, every document of
the source has ``ratio`` expected copies. Documents are laid out by size, their
expected copies are summed up in that order, one random offset per source is
added, and a document is emitted once per integer boundary it crosses. So the
number of copies is floor or ceil of the ratio, and the order by size keeps
the words taken near the target.

Rows equal in every column are counted first and handled as one group with a
count: their copies are the boundaries that the group crosses, shared out
equally, and they are written out again in chunks of ``CHUNK`` rows. So neither
a repeated row nor a null id ever meets itself in one task.

The prefix sum needs no sort in one task: it is ratio * rank, and ranks come
from counts by (source, size), by block within these, and a rank within the
block. A block holds about ``BLOCK_ROWS`` groups, dealt out by the hash of their
id, also of a source or size that has most rows. Sources are numbered by a range
sort and their targets found by repeated sums over them, so there may be many.

Null sources are a source of their own, ordered last. Null text has size 0.
Documents of size 0 have copies like any other, but take no words. Repeated
rows are documents of their own. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from ..session import scratch
from ..sources.snapshot import numbered
from .common import materialize
from .native import word_count

WEIGHTS, FACTOR, CAP, BLOCK_ROWS, CHUNK, SEED = (3, 1, 2), 1.5, 2, 1_000, 1_000, "mix-1"
#: Rows of a few numbers up to which a counted table is broadcast; beyond it both sides are shuffled.
MAX_BROADCAST = 500_000


def targets(groups: DataFrame, weights=WEIGHTS, factor: float = FACTOR, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per source of ``groups`` (source, size, n): source, source_size, target, ratio, offset; written."""
    spark = groups.sparkSession
    with scratch(spark) as made:
        per = materialize(spark, groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
        per = numbered(spark, per, [F.col("source").asc_nulls_last()])
        weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__row") % len(weights) + 1).cast("int")).cast("long")
        per = materialize(spark, per.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap), "weighed")
        # The level that open sources share rises as capped ones leave; it is final once no further one is capped.
        total = F.sum("source_size") * F.lit(factor)
        total = per.agg(total.alias("t")).first()["t"] or 0.0
        level, left, share, known = None, total, None, -1
        while True:
            capped = F.lit(False) if level is None else F.col("most") / F.col("weight") <= F.lit(level)
            got = per.agg(F.count_if(capped).alias("k"), F.sum(F.when(capped, F.col("most")).otherwise(0)).alias("m"), F.sum(F.when(~capped, F.col("weight")).otherwise(0)).alias("w")).first()
            if got["k"] == known:
                break
            known, left, share = got["k"], total - (got["m"] or 0), got["w"] or 0
            if not share:
                break
            level = left / share
        capped = F.lit(False) if level is None else F.col("most") / F.col("weight") <= F.lit(level)
        open_ = F.col("weight") * F.lit(float(left)) / F.lit(share) if share else F.col("most").cast("double")
        target = F.when(capped, F.col("most").cast("double")).otherwise(open_)
        offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("\x00")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        per = per.withColumn("target", target).select(
            "source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"), offset.alias("offset"))
        per = materialize(spark, per, "targets")
        made.keep(per)
    return per


def _hash(key: str) -> Column:
    """32 bits of the key's digest; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(0))


def allot(groups: DataFrame, key: str, ties: tuple[str, ...], block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """``groups`` (a written table: source, size, ``key``, ``ties``, n: how many rows are equal in these) plus source_size, target and total, the group's copies.

    Groups of equal size go by block, ``key`` and ``ties``.
    """
    per = targets(groups, **options).withColumnRenamed("source", "__src")
    few = per.count() <= MAX_BROADCAST // 4
    sizes = groups.groupBy("source", "size").agg(F.count("*").alias("__g"), F.sum("n").alias("__n"))
    by_size = Window.partitionBy("source").orderBy("size")
    sizes = sizes.select(F.col("source").alias("__source"), F.col("size").alias("__size"), F.ceil(F.col("__g") / block_rows).alias("__blocks"), (F.sum("__n").over(by_size) - F.col("__n")).alias("__below"))
    rows = groups.join(sizes, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size"))).drop("__source", "__size")
    # Null ids part by their ties; the rows of a block are few whatever repeats, as equal ones are one group.
    spread = F.when(F.col(key).isNull(), F.xxhash64(*ties) if ties else F.lit(0).cast("long")).otherwise(_hash(key))
    rows = rows.withColumn("__block", F.pmod(spread, F.col("__blocks")))
    counts = rows.groupBy("source", "size", "__block").agg(F.sum("n").alias("__n"))
    order = Window.partitionBy("source", "size").orderBy("__block")
    starts = counts.select(F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("__block").alias("__b"), (F.sum("__n").over(order) - F.col("__n")).alias("__before"))
    within = Window.partitionBy("source", "size", "__block").orderBy(F.col(key).asc_nulls_first(), *ties)
    rows = rows.withColumn("__in", F.sum("n").over(within) - F.col("n")).join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")) & (F.col("__block") == F.col("__b")))
    rows = rows.join(F.broadcast(per) if few else per, F.col("source").eqNullSafe(F.col("__src")))
    first = (F.col("__below") + F.col("__before") + F.col("__in")).cast("double")
    crossed = F.floor(F.col("ratio") * (first + F.col("n")) + F.col("offset")) - F.floor(F.col("ratio") * first + F.col("offset"))
    return rows.withColumn("total", crossed.cast("long")).select(*groups.columns, "source_size", "target", "total")


def _times(rows: DataFrame, count: Column) -> DataFrame:
    """Every row ``count`` times. Rows of many are parted into chunks first, which are dealt out."""
    few = rows.where(count.between(1, CHUNK)).withColumn("__i", F.explode(F.array_repeat(F.lit(0), count.cast("int")))).drop("__i")
    many = rows.where(count > CHUNK)
    if many.isEmpty():
        return few
    chunk = many.withColumn("__left", count).withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__left - 1) div {CHUNK}")))).repartition("__c")
    each = F.least(F.lit(CHUNK), F.col("__left") - F.col("__c") * CHUNK).cast("int")
    return few.unionByName(chunk.withColumn("__i", F.explode(F.array_repeat(F.lit(0), each))).drop("__left", "__c", "__i"))


def copies(sized: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``sized`` (source, size, ``key``, further columns that can be grouped by) plus source_size, target and copies.

    Rows of equal size go by the digest of ``key``, then by the further columns.
    Columns named ``__...``, n and total are used meanwhile and may be in the
    input under these names; one with the name of a result column is replaced.
    """
    spark = sized.sparkSession
    sized = sized.drop("source_size", "target", "copies")
    fixed = ["source", "size", key]
    names = {c: c if c in fixed else f"__x{i}" for i, c in enumerate(sized.columns)}
    with scratch(spark) as made:
        plain = sized.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        groups = materialize(spark, plain.groupBy(*names.values()).agg(F.count("*").alias("n")), "mix-groups")
        got = materialize(spark, allot(groups, key, tuple(n for n in names.values() if n not in fixed), **options), "mix-allotted")
        made.keep(got)
    low, over = F.expr("total div n"), F.expr("total % n")
    single = got.where("n = 1").withColumn("copies", F.col("total"))
    out = single
    if not got.where("n > 1").isEmpty():
        shared = got.where("n > 1")
        out = out.unionByName(_times(shared.withColumn("copies", low), F.col("n") - over)).unionByName(_times(shared.withColumn("copies", low + 1), over))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "source_size", "target", "copies")


def mix(sized: DataFrame, **options) -> DataFrame:
    """The mixture itself: every row of ``sized`` as often as it is emitted."""
    return _times(copies(sized, **options), F.col("copies")).select(*sized.columns)


def mix_documents(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture of whole rows of ``docs``, whatever further columns they have.

    Copies are worked out on narrow rows (id, source, size, the hash of the
    whole row) and joined to the whole rows, so texts are shuffled once at most.
    Rows equal in all columns are one, with all its copies.
    """
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    doc, text, source = (F.col(names[c]) for c in (id_col, text_col, source_col))
    plain = lambda f: F.col(names[f.name]) if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType) else F.col(names[f.name]).cast("string")
    mark = F.xxhash64(*[x for f in docs.schema for x in (plain(f), F.col(names[f.name]).isNull())])
    with scratch(spark) as made:
        sized = materialize(spark, rows.select(doc.alias("doc_id"), source.alias("source"), word_count(text).alias("size"), mark.alias("mark")), "sized")
        groups = materialize(spark, sized.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("n")), "mix-groups")
        found = allot(groups, "doc_id", ("mark",), **options).where("total > 0").select("mark", "n", "total")
        found = materialize(spark, found, "copies")
        made.keep(found)
    side = F.broadcast if found.count() <= MAX_BROADCAST else (lambda part: part)
    joined = lambda part: rows.withColumn("__mark", mark).join(side(part), F.col("__mark") == F.col("mark"))
    out = joined(found.where("n = 1"))
    shared = found.where("n > 1")
    if not shared.isEmpty():
        out = out.unionByName(joined(shared).dropDuplicates(["mark"]))
    return _times(out, F.col("total")).select(*[F.col(n).alias(c) for c, n in names.items()])


#: The rows of ``copies`` over documents, with taken = copies * size, in DuckDB's dialect.
ORACLE = f"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, source_size * {CAP} AS most FROM per),
l AS (SELECT *, (sum(source_size) OVER ()) * {FACTOR} AS total, ((sum(source_size) OVER ()) * {FACTOR} - coalesce(sum(most) OVER r, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER r, 0)) AS level
      FROM w WINDOW r AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, most / weight <= level AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE weight * CAST(total - sum(CASE WHEN capped THEN most ELSE 0 END) OVER () AS DOUBLE) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target,
      CAST('0x' || substr(md5('{SEED}' || coalesce(source, chr(0))), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM c),
b AS (SELECT *, coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT), 0) % n AS block FROM (SELECT *, (count(DISTINCT doc_id) OVER (PARTITION BY source, size) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS n FROM sized)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY size, block, doc_id NULLS FIRST) AS DOUBLE) AS rank FROM b)
SELECT k.doc_id AS doc_id, k.size AS size, t.source_size AS source_size, t.target AS target,
       CAST(k.size * CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * rank + u) - floor(t.target / t.source_size * (rank - 1) + u) ELSE 0 END AS BIGINT) AS taken
FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
"""
