"""Equi-joins with residual conditions, and totals over them that form no pairs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import EngineConfig

STRATEGIES = {"broadcast": "BROADCAST", "shuffle_hash": "SHUFFLE_HASH", "merge": "MERGE"}


def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], *, how: str = "inner",
              residual: Column | str | None = None, strategy: str | None = None, config: EngineConfig | None = None) -> DataFrame:
    """Join on ``l.a = r.b`` for each (a, b); NULL keys never match.

    Sides are aliased ``l`` and ``r``; ``residual`` may use both. Without a
    ``strategy`` Catalyst picks one by size and AQE revises it; the hint is a
    switch for tests and for sides whose size the caller has checked. Under a
    ``config`` with hash joins switched off, joins merge.
    """
    strategy = strategy or (config.join_strategy if config else None)
    left, right = left.alias("l"), right.alias("r")
    if strategy:
        right = right.hint(STRATEGIES[strategy])
    cond = None
    for a, b in on:
        c = F.col(f"l.{a}") == F.col(f"r.{b}")
        cond = c if cond is None else cond & c
    if residual is not None:
        cond = cond & (F.expr(residual) if isinstance(residual, str) else residual)
    return left.join(right, cond, how)


def counted(df: DataFrame, keys: dict[str, str] | list[str], *values: str) -> DataFrame:
    """One row per distinct ``keys`` (names, or name -> SQL): rows ``__n``, and of each int4 value v ``v__n``, ``v__sum``, ``v__lo`` and ``v__hi``.

    ``v__n`` counts the values that are not NULL, ``v__lo`` and ``v__hi`` are the extremes.
    """
    keys = keys if isinstance(keys, dict) else {k: k for k in keys}
    aggs = [F.count("*").alias("__n")]
    for v in values:
        aggs += [F.count(v).alias(f"{v}__n"), F.sum(v).alias(f"{v}__sum"), F.min(v).alias(f"{v}__lo"), F.max(v).alias(f"{v}__hi")]
    return df.groupBy(*[F.expr(c).alias(k) for k, c in keys.items()]).agg(*aggs)


def times(a: Column | str, b: Column | str) -> Column:
    """The exact product of two counts or sums."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("decimal(38,0)") * b.cast("decimal(38,0)")


def _summed(columns: dict[str, str], side: str) -> list[str]:
    return sorted({what[2:] for what in columns.values() if what.startswith(f"{side}.")})


def _as_longs(totals: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Decimal totals as int8, an error beyond it; a count of no rows is 0."""
    return totals.withColumns({n: (F.coalesce(F.col(n), F.lit(0)) if what == "*" else F.col(n)).cast("long") for n, what in columns.items()})


def join_totals(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], *, how: str = "inner", residual: str | None = None, where: str | None = None,
                left_by: dict[str, str] | None = None, right_by: dict[str, str] | None = None, by: list[str] = (), unequal: tuple[str, str] | None = None,
                strategy: str | None = None, config: EngineConfig | None = None, **columns: str) -> DataFrame:
    """Totals over an equi-join: each of ``columns`` is ``*`` (count of pairs), ``l.v`` or ``r.v`` (sum of an int4 column).

    Pairs of rows are never formed. Both sides are grouped by their keys first,
    with counts and sums, so the join meets a key once a side and a pair of
    groups adds products: the work grows with the rows, not with their pairs.

    ``left_by`` and ``right_by`` (name -> SQL) are further grouping columns,
    for ``by`` (the result's, as ``l.x`` or ``r.x``), ``residual`` and
    ``where``; these read them, the keys, and ``v__lo`` and ``v__hi`` of summed
    columns. ``unequal`` = (a, b) asks for ``l.a <> r.b`` in an inner join: the
    pairs that agree in them are taken off. Totals are exact; beyond int8 is an error.
    """
    if unequal:
        if how != "inner" or residual or where or by:
            raise ValueError("unequal columns are for inner joins without residual or grouping")
        left, right = left.where(F.col(unequal[0]).isNotNull()), right.where(F.col(unequal[1]).isNotNull())

    def totals(on):
        l_keys, r_keys = ({pair[i]: pair[i] for pair in on} for i in (0, 1))
        sides = counted(left, l_keys | (left_by or {}), *_summed(columns, "l")), counted(right, r_keys | (right_by or {}), *_summed(columns, "r"))
        pairs = equi_join(*sides, on, how=how, residual=residual, strategy=strategy, config=config)
        rows = {s: F.coalesce(F.col(f"{s}.__n"), F.lit(1)) for s in "lr"}  # one of them may be missing in an outer join
        other, out = {"l": rows["r"], "r": rows["l"]}, []
        for n, what in columns.items():
            if what == "*":
                out.append(F.sum(times(rows["l"], rows["r"])).alias(n))
            else:
                out += [F.sum(times(f"{what}__{x}", other[what[0]])).alias(n if x == "sum" else f"__{n}") for x in ("sum", "n")]
        return (pairs.where(where) if where else pairs).groupBy(*[F.col(c).alias(c.split(".")[-1]) for c in by]).agg(*out)

    if not unequal:
        found = totals(on)
    else:
        found = totals(on).alias("t").crossJoin(F.broadcast(totals([*on, unequal]).alias("e")))
        left_over = lambda n: F.col(f"t.{n}") - F.coalesce(F.col(f"e.{n}"), F.lit(0).cast("decimal(38,0)"))
        found = found.select(*[(left_over(n) if what == "*" else F.when(left_over(f"__{n}") > 0, left_over(n))).alias(n) for n, what in columns.items()])
    return _as_longs(found.drop(*[f"__{n}" for n in columns]), columns)


def join_totals_below(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], less: tuple[str, str], **columns: str) -> DataFrame:
    """``join_totals`` of an inner join with ``l.a < r.b`` for ``less`` = (a, b).

    Groups of both sides are sorted by key and value, and each right group meets
    the running totals of the left groups below it: n log n, whatever the pairs.
    A key's distinct values are summed up in one task.
    """
    sides = []
    for i, df in enumerate((left, right)):
        keys = {f"__k{j}": pair[i] for j, pair in enumerate(on)} | {"__x": less[i]}
        groups = counted(df, keys, *_summed(columns, "lr"[i])).dropna(subset=list(keys))
        names = {"__n": F.col("__n"), **{f"{v}__sum": F.col(f"{v}__sum") for v in _summed(columns, "lr"[i])}}
        sides.append(groups.select(*keys, F.lit(1 - i).alias("__left"), *[c.alias(f"{'lr'[i]}_{n}") for n, c in names.items()]))
    # at equal values right groups come first: only smaller left ones are below them
    below = Window.partitionBy(*[f"__k{j}" for j in range(len(on))]).orderBy("__x", "__left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    met = both.withColumns({c: F.sum(c).over(below) for c in both.columns if c.startswith("l_")}).where("__left = 0")
    part = lambda what: times("l___n", "r___n") if what == "*" else times(f"l_{what[2:]}__sum", "r___n") if what[0] == "l" else times("l___n", f"r_{what[2:]}__sum")
    return _as_longs(met.agg(*[F.sum(part(what)).alias(n) for n, what in columns.items()]), columns)


#: Rows of a side up to which a join without equal keys is allowed: that side is broadcast.
MAX_THETA_ROWS = 100_000


def theta_join(left: DataFrame, right: DataFrame, condition: Column | str, *, how: str = "inner") -> DataFrame:
    """A join by any condition over ``l`` and ``r``, against a right side of counted, bounded size."""
    if right.count() > MAX_THETA_ROWS:
        raise ValueError(f"the right side of a join without equal keys has more than {MAX_THETA_ROWS} rows")
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return left.alias("l").join(F.broadcast(right.alias("r")), cond, how)
