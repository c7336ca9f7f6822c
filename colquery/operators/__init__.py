"""Thin DataFrame operators; Catalyst and AQE choose the physical plan."""

from .aggregate import aggregate, group_aggregate
from .filter_project import create_function, filter_rows, gate, prepared, project
from .join import counted, equi_join, join_totals, join_totals_below, theta_join, times
from .lateral import lateral_agg, lateral_limit
from .limit import limit_offset, with_ties
from .setops import except_all, not_exists, union_all
from .unary import Int4Map, UnaryBatch, apply_batches

__all__ = ["Int4Map", "UnaryBatch", "aggregate", "apply_batches", "counted", "create_function", "except_all", "equi_join", "filter_rows", "gate", "group_aggregate",
           "join_totals", "join_totals_below", "lateral_agg", "lateral_limit", "limit_offset", "not_exists", "prepared", "project", "theta_join", "times", "union_all", "with_ties"]
