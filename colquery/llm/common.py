"""Shared pieces of the text operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import materialize, ship_package, work_path

__all__ = ["arrow_schema", "bounded_sample", "fold", "labelled", "letters", "map_batches", "materialize", "one_thread", "salted", "sigmoid", "text_of", "work_path"]

#: bytes.split() splits at exactly the six ASCII spaces 0x20 and 0x09-0x0D, and bytes.lower() changes A-Z alone.
LETTERS = bytes((c | 32) if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def letters(text: bytes) -> list[bytes]:
    """Lower-case runs of ASCII letters and non-ASCII bytes."""
    return text.translate(LETTERS).split()


def text_of(value) -> bytes:
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def one_thread() -> None:
    """For workers: the libraries they load must not start a thread per core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    return to_arrow_schema(parsed)


#: Rows handed to ``fn`` at a time, and the bytes of text after which a slice ends.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict | None], schema: str) -> DataFrame:
    """``fn`` gets columns as lists for a bounded slice of rows and returns output columns."""

    out_schema = arrow_schema(schema)
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, SLICE_ROWS)
                while part.num_rows > 1 and part.get_total_buffer_size() and part.nbytes > SLICE_BYTES:
                    part = part.slice(0, part.num_rows // 2)
                at += part.num_rows
                out = fn({name: col.to_pylist() for name, col in zip(part.schema.names, part.columns, strict=True)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in out_schema], schema=out_schema)

    return df.mapInArrow(run, schema)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def salted(*cols: str, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def bounded_sample(df: DataFrame, limit: int, *keys: str, seed: int = 17) -> DataFrame:
    """At most ``limit`` rows, those of smallest salted hash: deterministic, and a top-k per partition before the merge."""
    return df.withColumn("__h", salted(*keys, seed=seed)).orderBy("__h", *keys).limit(limit).drop("__h")


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int, measure: Callable[[str | None], list], kind: str, *, id_col: str, text_col: str, per_class: bool = False) -> tuple[list, list]:
    """Labels and measures of at most ``limit`` labelled documents (of each class, if ``per_class``), ordered by the hash of their ids.

    An id counts once: with its text of smallest hash, if texts share it, and
    not at all if its labels disagree. ``measure`` turns a text into an array of
    ``kind``. The ids that are broadcast and what reaches the driver have the
    limit for a bound, however often ids, labels or rows repeat.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("y")).where("y IS NOT NULL AND __id IS NOT NULL")
    known = known.groupBy("__id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("__id", "y")
    few = bounded_sample(known, limit, "__id")
    if per_class:
        few = bounded_sample(known.where("y = 1"), limit, "__id").unionByName(bounded_sample(known.where("y = 0"), limit, "__id"))
    text = F.col(f"`{text_col}`")
    joined = docs.select(F.col(f"`{id_col}`").alias("__id"), text.alias("text"), F.xxhash64(text, text.isNull()).alias("mark")).join(F.broadcast(few), "__id")
    seen: set[tuple] = set()  # a task measures copies once

    def run(c):
        at = [i for i, k in enumerate(zip(c["id"], c["mark"], strict=True)) if not (k in seen or seen.add(k))]
        return {"id": [c["id"][i] for i in at], "y": [c["y"][i] for i in at], "mark": [c["mark"][i] for i in at], "x": [measure(c["text"][i]) for i in at]}

    found = map_batches(joined.select(salted("__id", seed=17).alias("id"), "y", "mark", "text"), run, f"id long, y int, mark long, x array<{kind}>")
    rows = found.groupBy("id").agg(F.min_by(F.struct("y", "x"), "mark").alias("r")).select("id", "r.y", "r.x").toArrow()
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    x = rows.column("x").combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    return rows.column("y").to_numpy()[order].tolist(), [x[int(i)].values.to_numpy(zero_copy_only=False) for i in order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))

