"""The snapshot's ``filter`` mode as a data source: groups are skipped and rows filtered exactly while reading."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StructField, StructType

from .arrow_ipc import _fs
from .predicates import parse

NAME = "colquery_snapshot"


@dataclass
class SnapshotFile(InputPartition):
    file: str


class SnapshotReader(DataSourceReader):
    """One partition a data file. Filter columns are decoded first, the others only for storage groups with survivors."""

    def __init__(self, path: str, columns: list[str], filters: list[str], groups: list[int] | None):
        self.path, self.columns, self.filters = path, columns, filters
        self.groups = None if groups is None else set(groups)

    def partitions(self):
        from pyarrow.fs import FileSelector

        fs, p = _fs(f"{self.path}/data")
        return [SnapshotFile(f"{self.path}/data/{f.base_name}") for f in sorted(fs.get_file_info(FileSelector(p)), key=lambda f: f.base_name) if f.base_name.endswith(".parquet")]

    def read(self, partition: SnapshotFile) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        filters = [parse(t) for t in self.filters]
        fs, p = _fs(partition.file)
        with fs.open_input_file(p) as raw:
            file = pq.ParquetFile(raw)
            first = list(dict.fromkeys(["__group", *(f.column for f in filters)]))
            rest = [c for c in self.columns if c not in first]
            for k in range(file.num_row_groups):
                if self.groups is not None and not self._live(file, k):
                    continue
                table = file.read_row_group(k, columns=first).combine_chunks()
                mask = pa.array([True] * table.num_rows) if self.groups is None else pc.is_in(table["__group"], pa.array(sorted(self.groups), pa.int64()))
                for f in filters:
                    # A filter sees the survivors of those before it, so a guarded division doesn't raise.
                    at = pc.indices_nonzero(pc.fill_null(mask, False))
                    kept = pc.fill_null(f.mask(pc.take(table[f.column].combine_chunks() if isinstance(table[f.column], pa.ChunkedArray) else table[f.column], at)), False)
                    chosen = pc.filter(at, kept)
                    mask = pc.is_in(pa.array(range(table.num_rows), pa.uint64()), chosen)
                at = pc.indices_nonzero(pc.fill_null(mask, False))
                if not len(at):
                    continue
                found = table.take(at)
                if rest:
                    more = file.read_row_group(k, columns=rest).take(at)
                    for c in rest:
                        found = found.append_column(c, more[c])
                yield from found.select(self.columns).cast(pa.schema([(c, pa.int32()) for c in self.columns])).to_batches()

    def _live(self, file, k: int) -> bool:
        """Whether a row group may hold one of the groups."""
        names = file.schema_arrow.names
        stats = file.metadata.row_group(k).column(names.index("__group")).statistics
        return stats is None or not stats.has_min_max or any(stats.min <= g <= stats.max for g in self.groups)


class SnapshotSource(DataSource):
    """Options: path; columns, filters (JSON lists); groups (JSON list; absent: all)."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return StructType([StructField(c, IntegerType()) for c in json.loads(self.options["columns"])])

    def reader(self, schema: StructType):
        groups = self.options.get("groups")
        return SnapshotReader(self.options["path"], schema.names, json.loads(self.options.get("filters", "[]")), None if groups is None else json.loads(groups))


def load(spark: SparkSession, path: str, columns: list[str], filters: list[str], groups: list[int] | None):
    spark.dataSource.register(SnapshotSource)
    reader = spark.read.format(NAME).option("path", path).option("columns", json.dumps(columns)).option("filters", json.dumps(filters))
    return (reader if groups is None else reader.option("groups", json.dumps(groups))).load()
