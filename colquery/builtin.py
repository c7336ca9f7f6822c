"""The built-in operators and sources under their names in the registries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import operators as ops
from . import sources as src
from .plans import operators, sources

_frame = lambda df, *_, **__: isinstance(df, DataFrame)
_frames = lambda a, b, *_, **__: isinstance(a, DataFrame) and isinstance(b, DataFrame)
_ints = lambda df, *_, **__: all(kind == "int" for _, kind in df.dtypes)


def register_builtin() -> None:
    """Idempotent: names that are taken stay."""
    for name, fn in {"filter": ops.filter_rows, "project": ops.project, "aggregate": ops.aggregate, "group_aggregate": ops.group_aggregate,
                     "limit": ops.limit_offset, "with_ties": ops.with_ties, "gate": ops.gate}.items():
        if operators.find(name) is None:
            operators.register(name, fn, supports=_frame)
    for name, fn in {"equi_join": ops.equi_join, "theta_join": ops.theta_join, "union_all": ops.union_all, "except_all": ops.except_all,
                     "lateral_agg": ops.lateral_agg}.items():
        if operators.find(name) is None:
            operators.register(name, fn, supports=_frames)
    if operators.find("batches") is None:
        operators.register("batches", ops.apply_batches, supports=lambda df, operator, **options: operator(**options).supports(df))
    for name, fn in {"arrow": src.read_arrow, "snapshot": src.read_snapshot}.items():
        if sources.find(name) is None:
            sources.register(name, fn)
    for name, fn in {"arrow_export": src.export_arrow, "snapshot_compress": src.compress}.items():
        if sources.find(name) is None:
            sources.register(name, fn, supports=_ints)


register_builtin()
