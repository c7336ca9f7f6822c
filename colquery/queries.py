"""The query catalogue: name -> (spark, sf_dir) -> DataFrame, and its DuckDB oracle.

``FIX`` derives int4 columns with NULLs from lineitem in text that both
dialects read alike; ``JO`` and ``JI`` are the join sides, ``OI`` an int4 view
of orders with a unique key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .builtin import operators, sources
from .catalog import create_table_as, table
from .functions import int_div, int_mod, int_neg, murmur32
from .plans import EngineConfig, plan_counters
from .session import work_path
from .sources import encoding_stats, export_arrow, prune_stats, read_arrow, read_snapshot, read_table, remove_arrow, write_snapshot

FIX = ("SELECT l_orderkey, l_linenumber AS c1, CAST(CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_orderkey % 5000 + 2 END AS INT) AS c2, "
       "CAST(l_partkey % 97 AS INT) - 48 AS c3, CAST(l_suppkey AS INT) AS c4, CAST(CASE WHEN l_partkey % 101 = 0 THEN NULL ELSE l_partkey % 40 END AS INT) AS k1, "
       "CAST(l_suppkey % 7 AS INT) AS k2, l_returnflag AS t, l_shipdate AS d FROM lineitem")  # fmt: skip
JO = ("SELECT CAST(CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey % 4000 END AS INT) AS k1, CAST(o_orderkey % 7 AS INT) AS k2, "
      "CAST(o_custkey % 5 AS INT) AS k3, CAST(o_orderkey AS INT) AS v FROM orders")  # fmt: skip
JI = ("SELECT CAST(CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_partkey % 1500 END AS INT) AS k1, CAST(p_partkey % 7 AS INT) AS k2, "
      "p_size % 5 AS k3, CAST(p_partkey * 3 AS INT) AS v FROM part")  # fmt: skip
OI = ("SELECT CAST(o_orderkey AS INT) AS id, CAST(CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_custkey % 97 END AS INT) AS v, "
      "CAST(o_custkey % 100 AS INT) AS g, CAST((o_orderkey % 4) * 2 AS INT) AS s, o_orderstatus AS t FROM orders")  # fmt: skip

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str]] = {}


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """One of the SELECTs above over its table, read from the folder."""
    cols, name = text.removeprefix("SELECT ").rsplit(" FROM ", 1)
    depth, parts, start = 0, [], 0
    for i, ch in enumerate(cols):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(cols[start:i])
            start = i + 1
    return table(spark, sf_dir, name).selectExpr(*parts, cols[start:])


def add(name: str, query: Query, oracle: str) -> None:
    if name in CATALOGUE:
        raise ValueError(name)
    CATALOGUE[name] = (query, oracle)


# --- filters: each returns count, sum and max of the survivors -------------
DIGEST = {"n": "count(*)", "s": "sum(c3)", "m": "max(c2)"}
DIGEST_SQL = "SELECT count(*) AS n, CAST(sum(c3) AS BIGINT) AS s, max(c2) AS m"


def _filter(name: str, *conjuncts: str, duck: str | None = None, args: dict | None = None) -> None:
    add(name, lambda s, d: ops.aggregate(ops.filter_rows(view(s, d, FIX), *conjuncts, args=args), **DIGEST), f"{DIGEST_SQL} FROM ({FIX}) WHERE {duck or ' AND '.join(conjuncts)}")


_filter("filter_eq", "c2 = 100")
_filter("filter_ne", "c2 <> 100")
_filter("filter_lt", "c2 < 100")
_filter("filter_le", "c2 <= 100")
_filter("filter_gt", "c2 > 4000")
_filter("filter_ge", "c2 >= 4000")
_filter("filter_commuted", "100 > c2")
_filter("filter_between", "c2 BETWEEN 100 AND 900")
_filter("filter_arith", "(c2 + 3) * 2 > 200")
_filter("filter_mod", "c3 % 10 = -3")
_filter("filter_neg", "-c3 > 20")
_filter("filter_null_scalar", "c2 < :p", duck="c2 < CAST(NULL AS INT)", args={"p": None})
_filter("filter_residual_multicol", "c1 > 2", "(c1 + c3) % 5 = 0")
_filter("filter_or", "c2 < 50 OR c3 = 7")
_filter("filter_is_not_null", "c2 IS NOT NULL")
_filter("filter_is_null", "c2 IS NULL", "c1 < 5")
_filter("filter_param", "c2 > :lo", "c2 <= :hi", duck="c2 > 10 AND c2 <= 700", args={"lo": 10, "hi": 700})
_filter("filter_and_or", "(c1 = 1 AND c3 > 0) OR (c1 = 2 AND c3 < 0)")
_filter("filter_conjuncts", "c1 > 1", "c2 > 100", "c3 < 40", "c4 <> 3")
_filter("filter_const_left_arith", "1000 - c2 > 10")
_filter("filter_not_eq_text", "t <> 'R'")
add("filter_div", lambda s, d: ops.aggregate(ops.filter_rows(view(s, d, FIX), int_div(F.col("c2"), 7) > 100), **DIGEST), f"{DIGEST_SQL} FROM ({FIX}) WHERE c2 // 7 > 100")
add("filter_guarded_div", lambda s, d: ops.aggregate(ops.filter_rows(view(s, d, FIX), "CASE WHEN c3 <> 0 THEN 1000 div c3 > 50 ELSE false END"), **DIGEST),
    f"{DIGEST_SQL} FROM ({FIX}) WHERE CASE WHEN c3 <> 0 THEN 1000 // c3 > 50 ELSE false END")
add("filter_false_gate", lambda s, d: ops.aggregate(ops.gate(view(s, d, FIX), False), **DIGEST), f"{DIGEST_SQL} FROM ({FIX}) WHERE false")
add("filter_true_gate", lambda s, d: ops.aggregate(ops.gate(view(s, d, FIX), True), **DIGEST), f"{DIGEST_SQL} FROM ({FIX})")
add("filter_varlena_projection", lambda s, d: ops.project(ops.filter_rows(view(s, d, FIX), "c2 < 40"), c2="c2", padding="repeat(t, c1)", k="l_orderkey"),
    f"SELECT c2, repeat(t, c1) AS padding, l_orderkey AS k FROM ({FIX}) WHERE c2 < 40")


# --- projections ----------------------------------------------------------
def _project(name: str, expr, duck: str) -> None:
    add(name, lambda s, d: ops.project(view(s, d, OI), id="id", x=expr() if callable(expr) else expr), f"SELECT id, CAST({duck} AS INT) AS x FROM ({OI})")


_project("project_add", "v + 7", "v + 7")
_project("project_sub_left_scalar", "1000 - v", "1000 - v")
_project("project_mul", "v * 3", "v * 3")
_project("project_div", lambda: int_div(F.col("v") - 50, 7), "(v - 50) // 7")
_project("project_mod", lambda: int_mod(F.col("v") - 50, 7), "(v - 50) % 7")
_project("project_neg", lambda: int_neg(F.col("v")), "-v")
_project("project_const", "42", "42")
_project("project_multi_col", "v + g * s", "v + g * s")
_project("project_case", "CASE WHEN v > 50 THEN v ELSE -1 END", "CASE WHEN v > 50 THEN v ELSE -1 END")
_project("project_cast_long", "CAST(CAST(v AS BIGINT) + 1 AS INT)", "CAST(v AS BIGINT) + 1")
add("project_dup_expr", lambda s, d: ops.project(view(s, d, OI), id="id", a="(v + 3) * 2", b="(v + 3) * 2", c="(v + 3) * 2 + g"),
    f"SELECT id, (v + 3) * 2 AS a, (v + 3) * 2 AS b, (v + 3) * 2 + g AS c FROM ({OI})")


# --- aggregates -----------------------------------------------------------
def _agg(name: str, where: str | None, base: str = FIX, duck: dict[str, str] | None = None, **columns: str) -> None:
    def run(s, d):
        df = view(s, d, base)
        return ops.aggregate(ops.filter_rows(df, where) if where else df, **columns)

    add(name, run, "SELECT " + ", ".join(f"{(duck or {}).get(n, c)} AS {n}" for n, c in columns.items()) + f" FROM ({base})" + (f" WHERE {where}" if where else ""))


BIG = lambda x: f"CAST(sum({x}) AS BIGINT)"
_agg("agg_count_star", "c1 > 2", n="count(*)")
_agg("agg_count_col", None, n="count(c2)", m="count(k1)")
_agg("agg_sum", "c1 < 4", s="sum(c2)", duck={"s": BIG("c2")})
_agg("agg_min_max", "c3 > 0", lo="min(c2)", hi="max(c2)")
_agg("agg_all_four", "c2 > 50", n="count(c2)", s="sum(c3)", lo="min(c3)", hi="max(c3)", duck={"s": BIG("c3")})
_agg("agg_empty", "c2 < 0", n="count(*)", s="sum(c2)", lo="min(c2)", duck={"s": BIG("c2")})
_agg("agg_all_null", "c2 IS NULL", n="count(*)", m="count(c2)", s="sum(c2)", hi="max(c2)", duck={"s": BIG("c2")})
_agg("agg_expr_inputs", "c2 < 3000", s="sum(c2 + 1)", t="sum(c3 * 2 - c1)", hi="max(-c3)", duck={"s": BIG("c2 + 1"), "t": BIG("c3 * 2 - c1")})
_agg("agg_count_distinct", None, n="count(DISTINCT c2)", m="count(DISTINCT k1)")
_agg("agg_filter_clause", None, n="count(*) FILTER (WHERE c3 > 0)", s="sum(c3) FILTER (WHERE c1 = 1)", duck={"s": "CAST(sum(c3) FILTER (WHERE c1 = 1) AS BIGINT)"})
_agg("agg_median", None, base=OI, p="percentile_cont(0.5) WITHIN GROUP (ORDER BY id)")
add("agg_filter_expr", lambda s, d: ops.aggregate(ops.filter_rows(view(s, d, FIX), "(c1 + 3) * 2 > 10"), n="count(*)", nn="count(c2)", s="sum(c1 + 1)", lo="min(c1)", hi="max(c1)"),
    f"SELECT count(*) AS n, count(c2) AS nn, CAST(sum(c1 + 1) AS BIGINT) AS s, min(c1) AS lo, max(c1) AS hi FROM ({FIX}) WHERE (c1 + 3) * 2 > 10")
add("agg_avg", lambda s, d: ops.aggregate(view(s, d, OI), a="round(avg(v), 6)"), f"SELECT round(avg(v), 6) AS a FROM ({OI})")


def _group(name: str, keys: str, base: str = FIX, having: str | None = None, hide: bool = False, rollup: bool = False, **columns: str) -> None:
    ks = keys.split(",")
    duck = {n: (f"CAST({c} AS BIGINT)" if c.startswith("sum(") else c) for n, c in columns.items()}
    sql = "SELECT " + ", ".join([*([] if hide else ks), *(f"{c} AS {n}" for n, c in duck.items())]) + f" FROM ({base}) GROUP BY " + (f"ROLLUP ({keys})" if rollup else keys)
    if having:
        sql = f"SELECT * FROM ({sql}) WHERE {having}"
    add(name, lambda s, d: ops.group_aggregate(view(s, d, base), ks, having=having, hide_keys=hide, rollup=rollup, **columns), sql)


_group("agg_group_one_key", "c1", n="count(*)", s="sum(c3)", lo="min(c2)", hi="max(c2)")
_group("agg_group_null_key", "k1", n="count(*)", s="sum(c3)")
_group("agg_group_hidden_key", "k1", hide=True, n="count(*)", s="sum(c2)")
_group("agg_group_many", "c2", n="count(*)", s="sum(c3)", hi="max(c3)")
_group("agg_having", "c2", having="n > 12", n="count(*)", s="sum(c3)")
_group("agg_multi_key", "c1,k2", n="count(*)", s="sum(c3)")
_group("agg_rollup", "c1,k2", rollup=True, n="count(*)", s="sum(c3)")
_group("agg_text_key", "t", n="count(*)", s="sum(c3)")
add("agg_expr_key", lambda s, d: ops.group_aggregate(view(s, d, FIX).withColumn("b", F.expr("c3 % 5")), "b", n="count(*)"), f"SELECT c3 % 5 AS b, count(*) AS n FROM ({FIX}) GROUP BY 1")


# --- joins ----------------------------------------------------------------
def _sides(s, d):
    return view(s, d, JO), view(s, d, JI)


JDIGEST = {"n": "count(*)", "a": "sum(l.v)", "b": "sum(r.v)"}
#: The same as totals of a join that forms no pairs.
JTOTALS = {"n": "*", "a": "l.v", "b": "r.v"}
JDIGEST_SQL = "SELECT count(*) AS n, CAST(sum(l.v) AS BIGINT) AS a, CAST(sum(r.v) AS BIGINT) AS b"


def _join(name: str, keys: str, residual: str | None = None, how: str = "inner", strategy: str | None = None, right: str = JI, where: str | None = None, grouped: dict | None = None) -> None:
    """``grouped`` says to the operator what ``residual`` says, where that reads more than keys."""
    on = [(k, k) for k in keys.split(",")]

    def run(s, d):
        sides = view(s, d, JO), view(s, d, right)
        if grouped and "less" in grouped:
            return ops.join_totals_below(*sides, on, **grouped, **JTOTALS)
        return ops.join_totals(*sides, on, how=how, where=where, strategy=strategy, **(grouped or {"residual": residual}), **JTOTALS)

    cond = " AND ".join([*(f"l.{k} = r.{k}" for k in keys.split(",")), *([residual] if residual else [])])
    kind = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}[how]
    add(name, run, f"{JDIGEST_SQL} FROM ({JO}) l {kind} ({right}) r ON {cond}" + (f" WHERE {where}" if where else ""))


_join("join_one_key", "k1")
_join("join_two_keys", "k1,k2")
_join("join_three_keys", "k1,k2,k3")
_join("join_theta_residual", "k1,k2", "l.v < r.v", grouped={"less": ("v", "v")})
#: The residual after this by remainders; its first half adds extremes, which is an error where l.v + r.v leaves int4.
_THIRD, _THIRD_SUM = {"m": "v % 3"}, "l.v__hi + r.v__hi >= l.v__lo + r.v__lo AND (l.m + r.m) % 3 = 0"
_join("join_scalar_residual", "k1", "(l.v + r.v) % 3 = 0", grouped={"left_by": _THIRD, "right_by": _THIRD, "residual": _THIRD_SUM})
_join("join_null_keys", "k1", where="l.k1 IS NULL OR r.k1 IS NULL")
_join("join_duplicates", "k2")
_join("join_no_match", "k1", "l.k1 < 0")
_join("join_left", "k1", how="left")
_join("join_right", "k1", how="right")
_join("join_full", "k1", how="full")
for _hint in ("broadcast", "shuffle_hash", "merge"):
    _join(f"join_hint_{_hint}", "k1,k2", "l.v <> r.v", strategy=_hint, grouped={"unequal": ("v", "v")})
SKEW = "SELECT CAST(CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_orderkey % 900 END AS INT) AS k1, CAST(l_suppkey AS INT) AS v FROM lineitem"
add("join_skew", lambda s, d: ops.join_totals(view(s, d, SKEW), view(s, d, JI), [("k1", "k1")], **JTOTALS), f"{JDIGEST_SQL} FROM ({SKEW}) l JOIN ({JI}) r ON l.k1 = r.k1")
add("join_output_expr", lambda s, d: ops.equi_join(*_sides(s, d), [("k1", "k1"), ("k2", "k2")]).selectExpr("l.v AS v", "l.v + r.v AS projected"),
    f"SELECT l.v AS v, l.v + r.v AS projected FROM ({JO}) l JOIN ({JI}) r ON l.k1 = r.k1 AND l.k2 = r.k2")


def _chain(s: SparkSession, d: str) -> DataFrame:
    """Count and sum of l.v + o.g over a chain of two joins, each of grouped sides: the second join first, as it makes the fewest rows."""
    inner = ops.equi_join(ops.counted(view(s, d, JI), ["k1", "v"]), ops.counted(view(s, d, OI), ["id"], "g"), [("v", "id")])
    sums = [F.sum(ops.times("l.__n", f"r.{c}")).alias(c) for c in ("__n", "g__n", "g__sum")]
    inner = inner.groupBy("k1").agg(*sums, F.min("g__lo").alias("g__lo"), F.max("g__hi").alias("g__hi"))
    pairs = ops.equi_join(ops.counted(view(s, d, JO), ["k1"], "v"), inner, [("k1", "k1")])
    both = ops.times("l.v__sum", "r.g__n") + ops.times("l.v__n", "r.g__sum")
    within = F.expr("l.v__hi + r.g__hi >= l.v__lo + r.g__lo")  # adds the extremes: an error where l.v + o.g leaves int4
    return pairs.agg(F.coalesce(F.sum(ops.times("l.__n", "r.__n")), F.lit(0)).cast("long").alias("n"), F.sum(F.when(within, both)).cast("long").alias("s"))


add("join_chain", _chain,
    f"SELECT count(*) AS n, CAST(sum(l.v + o.g) AS BIGINT) AS s FROM ({JO}) l JOIN ({JI}) r ON l.k1 = r.k1 JOIN ({OI}) o ON r.v = o.id")
VALS = "(VALUES (1, 100), (2, 200), (3, 300)) AS x(k, payload)"
add("join_values", lambda s, d: ops.equi_join(view(s, d, JO), s.sql(f"SELECT * FROM {VALS}"), [("k1", "k")]).selectExpr("l.v AS v", "r.payload AS payload"),
    f"SELECT l.v AS v, x.payload AS payload FROM ({JO}) l JOIN {VALS} ON l.k1 = x.k")
add("join_range", lambda s, d: ops.equi_join(s.range(1, 131).selectExpr("CAST(id AS INT) AS k"), view(s, d, JI), [("k", "k1")]).selectExpr("l.k AS k", "r.v AS v"),
    f"SELECT g.k AS k, r.v AS v FROM (SELECT CAST(range AS INT) AS k FROM range(1, 131)) g JOIN ({JI}) r ON g.k = r.k1")
add("join_semi", lambda s, d: ops.equi_join(*_sides(s, d), [("k1", "k1")], how="left_semi"), f"SELECT * FROM ({JO}) l WHERE EXISTS (SELECT 1 FROM ({JI}) r WHERE l.k1 = r.k1)")
add("join_anti", lambda s, d: ops.equi_join(*_sides(s, d), [("k1", "k1")], how="left_anti"), f"SELECT * FROM ({JO}) l WHERE NOT EXISTS (SELECT 1 FROM ({JI}) r WHERE l.k1 = r.k1)")
add("agg_over_join", lambda s, d: ops.join_totals(*_sides(s, d), [("k1", "k1")], right_by={"k2": "k2"}, by=["r.k2"], n="*", s="l.v"),
    f"SELECT r.k2 AS k2, count(*) AS n, CAST(sum(l.v) AS BIGINT) AS s FROM ({JO}) l JOIN ({JI}) r ON l.k1 = r.k1 GROUP BY 1")
LAT = "(VALUES (0), (2), (4), (5)) AS o(k)"
add("join_lateral_agg", lambda s, d: ops.lateral_agg(s.sql(f"SELECT * FROM {LAT}"), view(s, d, OI), [("k", "s")], n="count(*)", t="sum(v)"),
    f"SELECT o.k AS k, x.n AS n, x.t AS t FROM {LAT}, LATERAL (SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS t FROM ({OI}) i WHERE i.s = o.k) x")
add("join_lateral_limit", lambda s, d: ops.lateral_limit(s.sql(f"SELECT * FROM {LAT}"), view(s, d, OI).select("id", "s"), [("k", "s")], ["id"], 5, 2).select("k", "id"),
    f"SELECT o.k AS k, x.id AS id FROM {LAT}, LATERAL (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY s ORDER BY id) AS rn, s FROM ({OI})) i WHERE i.s = o.k AND rn > 2 AND rn <= 7) x")


# --- limits ---------------------------------------------------------------
def _limit(name: str, n: int | None, offset: int | None = None) -> None:
    add(name, lambda s, d: ops.limit_offset(view(s, d, OI).select("id", "v"), n, offset, order_by="id"),
        f"SELECT id, v FROM ({OI}) ORDER BY id" + (f" LIMIT {n}" if n is not None else "") + (f" OFFSET {offset}" if offset else ""))


for _n in (0, 1, 63, 64, 65):
    _limit({0: "limit_zero", 1: "limit_one"}.get(_n, f"limit_{_n}"), _n)
_limit("limit_offset", 65, 15)
_limit("limit_null", None, None)
_limit("limit_offset_only", None, 64)
_limit("limit_huge", 2**63 - 1, 1)
_limit("limit_topk", 10)
add("limit_with_ties", lambda s, d: ops.with_ties(view(s, d, OI).select("id", "g"), 7, "g"), f"SELECT id, g FROM (SELECT id, g, rank() OVER (ORDER BY g) AS r FROM ({OI})) WHERE r <= 7")
add("limit_over_join", lambda s, d: ops.limit_offset(ops.equi_join(view(s, d, OI), view(s, d, JI), [("id", "v")]).selectExpr("l.id AS id", "r.k1 AS k1"), 20, 5, order_by=["id"]),
    f"SELECT l.id AS id, r.k1 AS k1 FROM ({OI}) l JOIN ({JI}) r ON l.id = r.v ORDER BY 1 LIMIT 20 OFFSET 5")
add("limit_early_stop_count", lambda s, d: ops.limit_offset(ops.filter_rows(view(s, d, OI), "id > 10"), 1).agg((F.count("*") == 1).alias("one")), f"SELECT count(*) = 1 AS one FROM (SELECT 1 FROM ({OI}) WHERE id > 10 LIMIT 1)")
add("order_by_nulls", lambda s, d: ops.limit_offset(view(s, d, OI).select("id", "v"), order_by=[F.col("v").asc_nulls_last(), "id"]), f"SELECT id, v FROM ({OI}) ORDER BY v NULLS LAST, id")

# --- set operations -------------------------------------------------------
#: Two projections of all rows.
_WA, _WB = f"SELECT v, g FROM ({OI})", f"SELECT g AS v, CAST(s * 7 AS INT) AS g FROM ({OI})"
_wa = lambda s, d: view(s, d, OI).select("v", "g")
_wb = lambda s, d: view(s, d, OI).selectExpr("g AS v", "CAST(s * 7 AS INT) AS g")
add("set_union_all", lambda s, d: ops.union_all(_wa(s, d), _wb(s, d)), f"{_WA} UNION ALL {_WB}")
add("set_except_all", lambda s, d: ops.except_all(_wa(s, d), _wb(s, d)), f"{_WA} EXCEPT ALL {_WB}")
add("set_not_exists", lambda s, d: ops.not_exists(view(s, d, OI).select("id", "v"), view(s, d, OI).selectExpr("g * 2 AS w"), [("v", "w")]), f"SELECT id, v FROM ({OI}) o WHERE NOT EXISTS (SELECT 1 FROM (SELECT g * 2 AS w FROM ({OI})) b WHERE b.w = o.v)")
add("scalar_subquery", lambda s, d: view(s, d, OI).crossJoin(F.broadcast(view(s, d, OI).agg(F.max("v").alias("hi")))).select("id", "hi"), f"SELECT id, (SELECT max(v) FROM ({OI})) AS hi FROM ({OI})")


# --- sources --------------------------------------------------------------
_written: dict[tuple[str, str, str], str] = {}


def _once(s: SparkSession, d: str, kind: str, write: Callable[[str], object]) -> str:
    """The path of a source over the folder's tables, written by the application's first query that reads it."""
    key = (s.sparkContext.applicationId, d, kind)
    if key not in _written:
        path = work_path(s, kind)
        write(path)
        _written[key] = path
    return _written[key]


def _snapshot(s: SparkSession, d: str) -> str:
    return _once(s, d, "snapshot", lambda path: write_snapshot(view(s, d, OI).select("id", "v", "g", "s"), path, 4096, ["id"]))


PRED, PRED_SQL = [("s", "=", 2), ("id", ">", 100)], "s = 2 AND id > 100"
for _mode in ("batch", "prune", "filter"):
    add(f"snapshot_{_mode}", lambda s, d, m=_mode: read_snapshot(s, _snapshot(s, d), PRED, mode=m, filters=["v + 1 < 50"]).select("id", "v", "g"),
        f"SELECT id, v, g FROM ({OI}) WHERE {PRED_SQL} AND v + 1 < 50")
_NUM = f"SELECT (row_number() OVER (ORDER BY id) - 1) // 4096 AS grp, * FROM ({OI})"
add("snapshot_group_stats", lambda s, d: s.read.parquet(_snapshot(s, d) + "/manifest").where("col = 'v'").selectExpr("`__group` AS grp", "n_rows", "n_values", "`min` AS lo", "`max` AS hi"),
    f"SELECT grp, count(*) AS n_rows, count(v) AS n_values, min(v) AS lo, max(v) AS hi FROM ({_NUM}) GROUP BY grp")
add("snapshot_prune_stats", lambda s, d: prune_stats(s, _snapshot(s, d), [("s", "=", 3), ("id", ">", 5000)]).select("groups_examined", "skipped_min_max", "skipped_membership", "rows_out"),
    f"SELECT count(*) AS groups_examined, count(*) FILTER (WHERE hi <= 5000) AS skipped_min_max, count(*) FILTER (WHERE hi > 5000) AS skipped_membership, CAST(0 AS BIGINT) AS rows_out FROM (SELECT grp, max(id) AS hi FROM ({_NUM}) GROUP BY grp)")
add("snapshot_encoding_stats", lambda s, d: encoding_stats(s, _snapshot(s, d)).where("col IN ('id', 's')").groupBy("col").agg(F.sum("batches").alias("batches")),
    f"SELECT c AS col, CAST((n + 63) // 64 AS BIGINT) AS batches FROM (SELECT count(*) AS n FROM ({OI})), (VALUES ('id'), ('s')) x(c)")
_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS col, r, r // 64 AS b, {c} AS v FROM n" for c in ("id", "v", "g", "s"))
add("snapshot_encoding_choice", lambda s, d: encoding_stats(s, _snapshot(s, d)),
    f"WITH n AS (SELECT row_number() OVER (ORDER BY id) - 1 AS r, id, v, g, s FROM ({OI})), c AS ({_CELLS}), "
    "f AS (SELECT col, r, b, CAST(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY col, b ORDER BY r), 0) AS BIGINT) AS x FROM c), "
    "d AS (SELECT col, b, x - lag(x) OVER (PARTITION BY col, b ORDER BY r) AS d FROM f), "
    "w AS (SELECT col, b, coalesce(min(d), 0) AS lo, coalesce(max(d), 0) AS hi FROM d GROUP BY col, b) "
    "SELECT col, CASE WHEN lo >= -128 AND hi <= 127 THEN 'DELTA8' WHEN lo >= -32768 AND hi <= 32767 THEN 'DELTA16' ELSE 'PLAIN' END AS encoding, count(*) AS batches FROM w GROUP BY 1, 2")  # fmt: skip


def _arrow(s: SparkSession, d: str) -> str:
    return _once(s, d, "arrow", lambda path: export_arrow(view(s, d, OI).select("id", "v", "g", "s"), path))


def _exported(s: SparkSession, d: str) -> str:
    """A stream of its own, written anew."""
    path = work_path(s, "arrow")
    export_arrow(view(s, d, OI).select("id", "v", "g", "s"), path)
    return path


add("arrow_roundtrip", lambda s, d: read_arrow(s, _exported(s, d)), f"SELECT id, v, g, s FROM ({OI})")
for _name, _opts in {"pushdown": {"pushdown": True}, "predicates": {"predicates": [("v", "<", 30), ("id", ">=", 50)]}, "nopush": {}, "row_path": {"rows": True}, "pruned": {"columns": ["id", "v"]}}.items():
    add(f"arrow_{_name}", lambda s, d, o=_opts: read_arrow(s, _arrow(s, d), **o).where("v < 30 AND id >= 50").select("id", "v"), f"SELECT id, v FROM ({OI}) WHERE v < 30 AND id >= 50")
add("arrow_join", lambda s, d: ops.equi_join(read_arrow(s, _arrow(s, d)), view(s, d, JI), [("id", "v")]).selectExpr("l.id AS id", "r.k1 AS k1"), f"SELECT l.id AS id, r.k1 AS k1 FROM ({OI}) l JOIN ({JI}) r ON l.id = r.v")
add("arrow_limit", lambda s, d: ops.limit_offset(read_arrow(s, _arrow(s, d)).select("id", "g"), 64, 1, order_by="id"), f"SELECT id, g FROM ({OI}) ORDER BY id LIMIT 64 OFFSET 1")
add("arrow_agg", lambda s, d: read_arrow(s, _arrow(s, d)).where("v < 10").agg(F.count("*").alias("n"), F.sum("g").alias("t")), f"SELECT count(*) AS n, CAST(sum(g) AS BIGINT) AS t FROM ({OI}) WHERE v < 10")


# --- scans of raw columns: the predicates reach the Parquet reader ----------
def _scan(name: str, where: str, args: dict | None = None, duck: str | None = None) -> None:
    def run(s, d):
        rows = ops.filter_rows(table(s, d, "lineitem"), where, args=args)
        return rows.agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"), F.min("l_partkey").alias("lo"), F.max("l_suppkey").alias("hi"))

    add(name, run, f"SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_partkey) AS lo, max(l_suppkey) AS hi FROM lineitem WHERE {duck or where}")


_scan("scan_range", "l_orderkey BETWEEN 200 AND 900")
_scan("scan_bitmap_and", "l_partkey <= 60 AND l_suppkey >= 5 AND l_linenumber = 2")
_scan("scan_bitmap_or", "l_partkey < 20 OR l_suppkey = 3")
_scan("scan_bitmap_and_or", "(l_partkey < 40 OR l_partkey > 150) AND (l_linenumber = 1 OR l_linenumber = 4)")
_scan("scan_range_param", "l_orderkey >= :lo AND l_orderkey < :hi AND l_linenumber < 5", args={"lo": 100, "hi": 1200}, duck="l_orderkey >= 100 AND l_orderkey < 1200 AND l_linenumber < 5")
_scan("scan_text_param", "l_returnflag = :p AND l_partkey > :pmin", args={"p": "R", "pmin": 30}, duck="l_returnflag = 'R' AND l_partkey > 30")
_scan("scan_recheck", "l_orderkey < 2000 AND (l_partkey + l_suppkey) % 5 = 0")


def _prepared(s: SparkSession, d: str) -> DataFrame:
    """One prepared filter, executed three times."""
    run = ops.prepared(view(s, d, FIX), "c2 > :lo", "c2 <= :hi")
    each = [run(lo=lo, hi=hi).agg(F.lit(k).alias("k"), F.count("*").alias("n"), F.sum("c3").alias("s")) for k, (lo, hi) in enumerate(((10, 700), (700, 2000), (5, None)))]
    return each[0].unionAll(each[1]).unionAll(each[2])


add("filter_prepared", _prepared, " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS n, CAST(sum(c3) AS BIGINT) AS s FROM ({FIX}) WHERE c2 > {lo} AND c2 <= {hi}" for k, (lo, hi) in enumerate(((10, 700), (700, 2000), (5, "CAST(NULL AS INT)")))))


def _operator(s: SparkSession, d: str) -> DataFrame:
    ops.create_function(s, "colquery_same", "a INT, b INT", "BOOLEAN", "a = b")
    return ops.aggregate(view(s, d, FIX).where("colquery_same(c2, 100) OR colquery_same(c3, -7)"), **DIGEST)


add("filter_user_operator", _operator, f"{DIGEST_SQL} FROM ({FIX}) WHERE c2 = 100 OR c3 = -7")
add("project_format", lambda s, d: ops.project(view(s, d, OI), id="id", x="format_string('%d/%s', g, t)", y="t || ':' || s"), f"SELECT id, format('{{}}/{{}}', g, t) AS x, t || ':' || s AS y FROM ({OI})")

# --- grouping beyond one set of keys ---------------------------------------
_SUMS = {"n": "count(*)", "s": "sum(c3)"}
_SUMS_SQL = "count(*) AS n, CAST(sum(c3) AS BIGINT) AS s"
add("agg_cube", lambda s, d: ops.group_aggregate(view(s, d, FIX), ["c1", "k2"], cube=True, **_SUMS), f"SELECT c1, k2, {_SUMS_SQL} FROM ({FIX}) GROUP BY CUBE (c1, k2)")
add("agg_grouping_sets", lambda s, d: ops.group_aggregate(view(s, d, FIX), ["c1", "k2", "t"], sets=[["c1", "t"], ["k2"], []], **_SUMS), f"SELECT c1, k2, t, {_SUMS_SQL} FROM ({FIX}) GROUP BY GROUPING SETS ((c1, t), (k2), ())")
add("agg_ordered", lambda s, d: ops.group_aggregate(view(s, d, OI), "g", ids="listagg(CAST(id AS STRING), ',') WITHIN GROUP (ORDER BY v NULLS LAST, id)"),
    f"SELECT g, string_agg(CAST(id AS VARCHAR), ',' ORDER BY v NULLS LAST, id) AS ids FROM ({OI}) GROUP BY g")

# --- joins beyond equal keys, and skew by a hash ----------------------------
add("join_nonequi", lambda s, d: ops.theta_join(table(s, d, "supplier"), table(s, d, "nation"), "l.s_nationkey < r.n_nationkey AND r.n_regionkey <> 2").groupBy("n_nationkey").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("lo")),
    "SELECT n_nationkey, count(*) AS n, min(s_suppkey) AS lo FROM supplier l JOIN nation r ON l.s_nationkey < r.n_nationkey AND r.n_regionkey <> 2 GROUP BY 1")
add("join_hash_off", lambda s, d: ops.join_totals(*_sides(s, d), [("k1", "k1")], config=EngineConfig(enable_hash_join=False), **JTOTALS), f"{JDIGEST_SQL} FROM ({JO}) l JOIN ({JI}) r ON l.k1 = r.k1")
#: The murmur finalizer in DuckDB's dialect, by steps over rows (k, h).
_STEPS = "SELECT k, xor(h, h >> 16) AS h FROM (SELECT k, CAST((CAST(h AS HUGEINT) * 3266489909) % 4294967296 AS BIGINT) AS h FROM (SELECT k, xor(h, h >> 13) AS h FROM (SELECT k, CAST((CAST(h AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT) AS h FROM (SELECT k, xor(h, h >> 16) AS h FROM ({}) a) b) c) d) e"
_MK = _STEPS.format("SELECT o_orderkey AS k, o_orderkey AS h FROM orders")
add("murmur_keys", lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("k"), murmur32(F.col("o_orderkey")).alias("h")), f"SELECT k, h FROM ({_MK})")


def _murmur_skew(s: SparkSession, d: str) -> DataFrame:
    """Only keys of one hash partition of eight on both sides, as a spilling join would meet them."""
    keys = table(s, d, "orders").where(murmur32(F.col("o_orderkey")).bitwiseAND(F.lit(7)) == 0).selectExpr("CAST(o_orderkey AS INT) AS k1", "CAST(o_custkey AS INT) AS v")
    lines = table(s, d, "lineitem").selectExpr("CAST(l_orderkey AS INT) AS k1", "l_linenumber AS v")
    return ops.equi_join(lines, keys, [("k1", "k1")], strategy="merge").agg(*[F.expr(c).alias(n) for n, c in JDIGEST.items()])


add("join_murmur_skew", _murmur_skew, f"{JDIGEST_SQL} FROM (SELECT l_orderkey AS k1, l_linenumber AS v FROM lineitem) l JOIN (SELECT o.o_orderkey AS k1, o.o_custkey AS v FROM orders o JOIN ({_MK}) m ON m.k = o.o_orderkey WHERE m.h & 7 = 0) r ON l.k1 = r.k1")

# --- switches, registries, batch operators, counters ------------------------
_PICK = f"SELECT id, v, g FROM ({OI}) WHERE {PRED_SQL} AND v + 1 < 50"
for _name, _config in {"on": EngineConfig(), "off": EngineConfig(snapshot_enable=False), "prune": EngineConfig(snapshot_mode="prune")}.items():
    add(f"snapshot_table_{_name}", lambda s, d, c=_config: read_table(view(s, d, OI).select("id", "v", "g", "s"), _snapshot(s, d), PRED, filters=["v + 1 < 50"], config=c).select("id", "v", "g"), _PICK)
for _name, _config in {"on": EngineConfig(), "off": EngineConfig(arrow_pushdown=False, arrow_column_pruning=False)}.items():
    add(f"arrow_switch_{_name}", lambda s, d, c=_config: read_arrow(s, _arrow(s, d), columns=["id", "v"], predicates=[("v", "<", 30), ("id", ">=", 50)], config=c), f"SELECT id, v FROM ({OI}) WHERE v < 30 AND id >= 50")
add("snapshot_exact_filter", lambda s, d: read_snapshot(s, _snapshot(s, d), [("s", "=", 2)], filters=["(v + 3) * 2 > 20", "g % 7 = 3", "v + g < 120"]).agg(F.count("*").alias("n"), F.sum("id").alias("t")),
    f"SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS t FROM ({OI}) WHERE s = 2 AND (v + 3) * 2 > 20 AND g % 7 = 3 AND v + g < 120")
add("registry_operators", lambda s, d: operators.apply("group_aggregate", operators.apply("filter", view(s, d, OI), "v > 20"), "s", n="count(*)", t="sum(v)"), f"SELECT s, count(*) AS n, CAST(sum(v) AS BIGINT) AS t FROM ({OI}) WHERE v > 20 GROUP BY s")
add("registry_source", lambda s, d: sources.apply("snapshot", s, _snapshot(s, d), [("id", "<=", 700)], columns=["id", "g"]), f"SELECT id, g FROM ({OI}) WHERE id <= 700")
add("unary_batches", lambda s, d: operators.apply("batches", view(s, d, OI).select("id", "v"), ops.Int4Map, column="v", factor=3, add=1), f"SELECT id, CAST(v * 3 + 1 AS INT) AS v FROM ({OI})")
add("create_table_as", lambda s, d: (create_table_as(view(s, d, OI).where("v > 50").select("id", "v"), "colquery_big"), s.sql("SELECT v, count(*) AS n FROM colquery_big GROUP BY v"))[1], f"SELECT v, count(*) AS n FROM ({OI}) WHERE v > 50 GROUP BY v")


def _counters(s: SparkSession, d: str) -> DataFrame:
    """Rows that the plan's filter let through, from its own counters."""
    got = [n["numOutputRows"] for n in plan_counters(view(s, d, OI).where("v > 40 AND g % 3 = 1")) if n["node"] == "Filter"]
    return s.createDataFrame([(got[0],)], "rows_out long")


add("plan_counters", _counters, f"SELECT count(*) AS rows_out FROM ({OI}) WHERE v > 40 AND g % 3 = 1")


def _removed(s: SparkSession, d: str) -> DataFrame:
    """A stream is exported, counted, removed, and removed again."""
    path = _exported(s, d)
    n = read_arrow(s, path).count()
    remove_arrow(path)
    remove_arrow(path)
    return s.createDataFrame([(n, s._jvm.java.io.File(path.removeprefix("file:")).exists() if "://" not in path.removeprefix("file://") else False)], "n long, found boolean")


add("arrow_remove", _removed, f"SELECT count(*) AS n, false AS found FROM ({OI})")


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items()}
