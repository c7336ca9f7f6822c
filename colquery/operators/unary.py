"""Operators over record batches: one input, one output."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship_package


class UnaryBatch:
    """A batch operator, made anew for each task: ``open``, ``process`` for each batch, ``close``.

    ``process`` returns a batch, None for no rows, or raises ``Stop`` to read no
    further. ``close`` may return a last batch. ``schema`` is the output's, or
    None for the input's; ``supports`` says whether it can be put over an input.
    """

    class Stop(Exception):
        """Ends a task's input; its argument, if any, is the last batch."""

    schema: str | None = None

    def supports(self, df: DataFrame) -> bool:
        return True

    def open(self) -> None:
        pass

    def process(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        raise NotImplementedError

    def close(self) -> pa.RecordBatch | None:
        return None


def apply_batches(df: DataFrame, operator: type[UnaryBatch], **options) -> DataFrame:
    """``df`` through the operator, task by task."""
    ship_package(df.sparkSession)
    if not operator(**options).supports(df):
        raise ValueError(f"{operator.__name__} does not support this input")

    given = operator(**options).schema
    schema = df.schema if given is None else StructType.fromDDL(given)
    fields = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = lambda b: pa.RecordBatch.from_arrays(b.columns, schema=fields)
        op = operator(**options)
        op.open()
        try:
            for batch in batches:
                out = op.process(batch)
                if out is not None:
                    yield same(out)
        except UnaryBatch.Stop as stop:
            if stop.args:
                yield same(stop.args[0])
        last = op.close()
        if last is not None:
            yield same(last)

    return df.mapInArrow(run, schema)


class Int4Map(UnaryBatch):
    """``column`` times ``factor`` plus ``add``, checked int4; the other columns pass."""

    def __init__(self, column: str, factor: int = 1, add: int = 0):
        self.column, self.factor, self.add = column, factor, add

    def supports(self, df: DataFrame) -> bool:
        return dict(df.dtypes).get(self.column) == "int"

    def process(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        import pyarrow.compute as pc

        k = batch.schema.get_field_index(self.column)
        value = pc.add_checked(pc.multiply_checked(batch.column(k), pa.scalar(self.factor, pa.int32())), pa.scalar(self.add, pa.int32()))
        return batch.set_column(k, batch.schema.field(k), value)
