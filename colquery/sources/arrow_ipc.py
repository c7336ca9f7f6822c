"""Arrow IPC streams as a Python data source, and their exporter.

A dataset is a folder of stream files (or one file). Each file is one input
partition. Predicates given to ``read_arrow`` are EXACT: they are evaluated on
the record batches, before any other column is handed on. Filters put on the
DataFrame stay with Spark unless ``pushdown`` is set; then ``column OP int``
is EXACT too and the rest UNSUPPORTED. Spark 4.1 keeps a reader's pushed
filters with the loaded relation, so a DataFrame read with ``pushdown`` must
be used by one query only; predicates don't have that limit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition,
                                    IsNotNull, LessThan, LessThanOrEqual)
from pyspark.sql.types import IntegerType, StructField, StructType

from ..plans.config import EngineConfig
from ..session import ship_package

NAME = "colquery_arrow"
COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
OPERATORS = {"=": EqualTo, ">": GreaterThan, ">=": GreaterThanOrEqual, "<": LessThan, "<=": LessThanOrEqual}


def _fs(path: str):
    from pyarrow.fs import FileSystem

    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    elif path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return FileSystem.from_uri(path)


def list_streams(path: str) -> list[str]:
    from pyarrow.fs import FileSelector, FileType

    fs, p = _fs(path)
    info = fs.get_file_info(p)
    if info.type == FileType.File:
        return [path]
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    base = path.rstrip("/")
    return sorted(f"{base}/{x.base_name}" for x in fs.get_file_info(FileSelector(p)) if x.base_name.endswith(".arrows"))


def _schema(path: str) -> pa.Schema:
    files = list_streams(path)
    if not files:
        raise ValueError(f"{path} has no Arrow stream")
    fs, p = _fs(files[0])
    with fs.open_input_stream(p) as f:
        schema = ipc.open_stream(f).schema
    for field in schema:
        if field.type != pa.int32():
            raise ValueError(f'column "{field.name}" has type {field.type}; only int32 columns are read')
    return schema


@dataclass
class StreamFile(InputPartition):
    file: str


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], batch_rows: bool, predicates=()):
        self.path, self.columns, self.by_batch = path, columns, batch_rows
        self.given = [(OPERATORS[op], name, value) for name, op, value in predicates]
        self.filters: list = list(self.given)

    def partitions(self):
        return [StreamFile(f) for f in list_streams(self.path)]

    def _mask(self, batch: pa.RecordBatch):
        mask = None
        for kind, name, value in self.filters:
            col = batch.column(batch.schema.get_field_index(name))
            m = pc.is_valid(col) if kind is IsNotNull else COMPARE[kind](col, pa.scalar(value, pa.int32()))
            mask = m if mask is None else pc.and_kleene(mask, m)
        return mask

    def read(self, partition: StreamFile) -> Iterator:
        """Filter columns of every record batch are decoded first, the others only of batches with survivors."""
        fs, p = _fs(partition.file)
        masks = None
        if self.filters:
            tested = list(dict.fromkeys(n for _, n, _ in self.filters))
            masks = [pc.fill_null(self._mask(batch), False) for batch in self._decoded(fs, p, tested)]
            if not any(m.true_count for m in masks):
                return
        for k, out in enumerate(self._decoded(fs, p, self.columns, None if masks is None else [bool(m.true_count) for m in masks])):
            if out is None:
                continue
            if masks is not None:
                out = out.filter(masks[k])
            if not out.num_rows:
                continue
            if self.by_batch:
                yield out.select(self.columns)
            else:
                yield from zip(*(c.to_pylist() for c in out.select(self.columns).columns))

    def _decoded(self, fs, path: str, columns: list[str], wanted: list[bool] | None = None) -> Iterator[pa.RecordBatch | None]:
        """Record batches with ``columns``; None, undecoded, for those that aren't wanted."""
        if wanted is not None and not all(wanted):
            with fs.open_input_stream(path) as f:
                messages = ipc.MessageReader.open_stream(f)
                schema = ipc.read_schema(messages.read_next_message())
                for want in wanted:
                    message = messages.read_next_message()
                    yield ipc.read_record_batch(message, schema).select(columns) if want else None
            return
        with fs.open_input_stream(path) as f:
            schema = ipc.open_stream(f).schema
        with fs.open_input_stream(path) as f:
            yield from ipc.open_stream(f, options=ipc.IpcReadOptions(included_fields=sorted(schema.get_field_index(c) for c in columns)))


class PushingArrowReader(ArrowReader):
    def pushFilters(self, filters):
        known, self.filters = set(self.columns), list(self.given)
        for f in filters:
            name = getattr(f, "attribute", (None,))
            if type(f) in COMPARE and len(name) == 1 and name[0] in known and isinstance(f.value, int):
                self.filters.append((type(f), name[0], f.value))
            elif type(f) is IsNotNull and len(name) == 1 and name[0] in known:
                self.filters.append((IsNotNull, name[0], None))
            else:
                yield f


class ArrowIpcSource(DataSource):
    """Options: path; columns (comma separated, default all); predicates (JSON); pushdown (false); rows (false: record batches)."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        wanted = self._columns()
        return StructType([StructField(c, IntegerType()) for c in wanted])

    def _columns(self) -> list[str]:
        names = _schema(self.options["path"]).names
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or names
        if missing := [c for c in wanted if c not in names]:
            raise ValueError(f"no such column: {', '.join(missing)}")
        return wanted

    def reader(self, schema: StructType):
        kind = PushingArrowReader if self.options.get("pushdown", "false").lower() == "true" else ArrowReader
        predicates = json.loads(self.options.get("predicates", "[]"))
        if unknown := [n for n, _, _ in predicates if n not in _schema(self.options["path"]).names]:
            raise ValueError(f"no such column: {', '.join(unknown)}")
        return kind(self.options["path"], schema.names, self.options.get("rows", "false").lower() != "true", predicates)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowIpcSource)


def read_arrow(spark: SparkSession, path: str, *, columns=None, predicates=(), pushdown: bool = False, rows: bool = False, config: EngineConfig | None = None) -> DataFrame:
    """``columns`` is the column pruning: only those and the predicates' are decoded.

    Under a ``config`` whose switches are off, columns are pruned and predicates
    evaluated by Spark after reading; the rows are the same.
    """
    register(spark)
    if config is not None and predicates and not (config.enable and config.arrow_pushdown):
        df = read_arrow(spark, path, rows=rows, config=config)
        for name, op, value in predicates:
            df = df.where(F.lit(None).cast("boolean") if value is None else F.expr(f"`{name}` {op} {int(value)}"))
        return df.select(*columns) if columns else df
    if config is not None and columns and not (config.enable and config.arrow_column_pruning):
        return read_arrow(spark, path, predicates=predicates, pushdown=pushdown, rows=rows).select(*columns)
    reader = spark.read.format(NAME).option("path", path).option("predicates", json.dumps([list(p) for p in predicates])).option("pushdown", str(pushdown).lower()).option("rows", str(rows).lower())
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return reader.load()


def export_arrow(df: DataFrame, path: str, batch_rows: int = 4096) -> int:
    """Write one IPC stream per partition under ``path`` and return the number of rows.

    Executors write under temporary names and rename, so a repeated task
    replaces its own file; nothing passes through the driver but the counts.
    """
    if batch_rows <= 0:
        raise ValueError("batch_rows must be positive")
    for f in df.schema:
        if not isinstance(f.dataType, IntegerType):
            raise ValueError(f'column "{f.name}" is not int')
    schema = pa.schema([(c, pa.int32()) for c in df.columns])
    fs, p = _fs(path)
    fs.create_dir(p)

    def write(batches):
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, p = _fs(path)
        temp, final, n = f"{p}/.{part}-{uuid.uuid4().hex}", f"{p}/part-{part:06d}.arrows", 0
        with fs.open_output_stream(temp) as f, ipc.new_stream(f, schema) as out:
            pending, held = [], 0
            for batch in batches:
                batch = pa.RecordBatch.from_arrays(batch.columns, schema=schema)
                n, held = n + batch.num_rows, held + batch.num_rows
                pending.append(batch)
                while held >= batch_rows:
                    whole = pa.Table.from_batches(pending, schema).combine_chunks()
                    out.write_table(whole.slice(0, batch_rows), batch_rows)
                    rest = whole.slice(batch_rows)
                    pending, held = rest.to_batches(), rest.num_rows
            if held:
                out.write_table(pa.Table.from_batches(pending, schema).combine_chunks(), batch_rows)
        fs.move(temp, final)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return df.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()[0]


def remove_arrow(path: str) -> None:
    """A missing file or folder is fine."""
    from pyarrow.fs import FileType

    fs, p = _fs(path)
    kind = fs.get_file_info(p).type
    if kind == FileType.Directory:
        fs.delete_dir(p)
    elif kind == FileType.File:
        fs.delete_file(p)
