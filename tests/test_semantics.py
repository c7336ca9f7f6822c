"""Golden values, errors, registries, snapshots and Arrow streams on small fixtures."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from colquery import operators as ops
from colquery.functions import int_div, int_mod, int_neg, murmur32
from colquery.plans import EngineConfig, Registry, plan_counters
from colquery.session import work_path
from colquery.sources import export_arrow, prune_stats, read_arrow, read_snapshot, remove_arrow, write_snapshot


def rows(spark, n, *cols, start=1):
    return spark.range(start, n + 1).selectExpr(*[f"CAST({c} AS INT) AS {name}" for name, c in (x.split("=", 1) for x in cols)])


@pytest.fixture(scope="module")
def values(spark):
    return rows(spark, 130, "v=CASE WHEN id = 1 THEN -2147483648 WHEN id = 2 THEN 2147483647 WHEN id % 17 = 0 THEN NULL ELSE id - 66 END", "id=id")


@pytest.fixture(scope="module")
def plain(spark):
    return rows(spark, 80, "c1=id", "c2=CASE WHEN id % 13 = 0 THEN NULL ELSE id + 2 END", "c4=id + 4", "c6=id + 6")


def test_comparisons(values):
    assert values.where("v < 0").count() == 61
    assert ops.filter_rows(values, "v < :p", args={"p": None}).count() == 0
    assert values.where("v = 0").count() == 1


def test_goldens(plain):
    assert ops.aggregate(ops.filter_rows(plain, "c2 + 3 < 20"), s="sum(c6 + 3)").first()[0] == 209
    assert ops.aggregate(ops.filter_rows(plain, "c2 + :p < 20", args={"p": None}), s="sum(c6 + 3)").first()[0] is None
    assert [plain.where(c).count() for c in ("c2 < 10", "c6 < 14", "c4 < 14")] == [7, 7, 9]
    assert tuple(ops.aggregate(plain.where("false"), n="count(*)", s="sum(c2)").first()) == (0, None)


@pytest.mark.parametrize("column", ["c6 + 2147483647", "10 div (c1 - 1)", "c1 % (c1 - 1)"])
def test_errors(plain, column):
    with pytest.raises(PySparkException):
        ops.aggregate(plain, s=f"sum({column})").collect()


def test_int4(values, spark):
    low = values.where("id = 1")
    for bad in (int_neg(F.col("v")), int_div(F.col("v"), -1)):
        with pytest.raises(PySparkException):
            low.agg(F.sum(bad)).collect()
    got = spark.sql("SELECT -7 AS a, 7 AS b").select(int_div(F.col("a"), 2), int_mod(F.col("a"), 3), int_div(F.col("b"), -2)).first()
    assert tuple(got) == (-3, -1, -3)
    assert low.select(int_mod(F.col("v"), -1)).first()[0] == 0


def test_murmur(spark):
    def fin(h):
        h ^= h >> 16
        h = h * 2246822507 % 2**32
        h ^= h >> 13
        h = h * 3266489909 % 2**32
        return h ^ h >> 16

    got = spark.range(0, 3000, 7).select("id", murmur32(F.col("id"))).collect()
    assert all(b == fin(a) for a, b in got)


@pytest.mark.parametrize("n,m,want", [(0, 0, 0), (1, 0, 1), (63, 0, 63), (64, 0, 64), (65, 0, 65), (65, 15, 65), (None, None, 80), (None, 64, 16), (2**63 - 1, 1, 79), (5, 2**40, 0)])
def test_limits(plain, n, m, want):
    got = [r[0] for r in ops.limit_offset(plain.select("c1"), n, m, order_by="c1").collect()]
    assert len(got) == want and (not got or got[0] == (m or 0) + 1)


def test_limit_errors(plain):
    for args, text in (((-1,), "LIMIT must not be negative"), ((None, -1), "OFFSET must not be negative")):
        with pytest.raises(ValueError, match=text):
            ops.limit_offset(plain, *args)


def test_with_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 6), (5, 6)], "id int, g int")
    assert {r.id for r in ops.with_ties(df, 1, "g").collect()} == {1, 2}
    assert {r.id for r in ops.with_ties(df, 3, "g").collect()} == {1, 2, 4, 5}
    assert ops.with_ties(df, 9, ["g", "id"]).count() == 5 and ops.with_ties(df, 0, "g").count() == 0


def test_joins_with_nulls(spark):
    outer = rows(spark, 130, "k1=CASE WHEN id % 29 = 0 THEN NULL ELSE id % 40 END", "v=id")
    vals = spark.sql("SELECT * FROM VALUES (1, 100), (2, 200), (3, 300) AS x(k, payload)")
    got = ops.equi_join(outer.where("v > 10"), vals, [("k1", "k")]).agg(F.count("*"), F.sum("l.v"), F.sum("r.payload")).first()
    assert tuple(got) == (9, 738, 1800)
    both = [ops.equi_join(outer, outer, [("k1", "k1")], strategy=s).count() for s in (None, "broadcast", "shuffle_hash", "merge")]
    assert len(set(both)) == 1


@pytest.fixture(scope="module")
def snapshot(spark):
    path = work_path(spark, "groups")
    df = rows(spark, 384, "c1=id", "c2=(id % 4) * 2", "c3=id + 1000")
    assert write_snapshot(df, path, 128, ["c1"]) == 3
    return path


def test_snapshot_goldens(spark, snapshot):
    s = prune_stats(spark, snapshot, [("c1", ">=", 130), ("c1", "<=", 140)]).first()
    assert (s.groups_examined, s.skipped_min_max, s.rows_out) == (3, 2, 11)
    s = prune_stats(spark, snapshot, [("c2", "=", 3)]).first()
    assert (s.skipped_membership, s.rows_out) == (3, 0)
    s = prune_stats(spark, snapshot, [("c2", "=", 2), ("c1", ">", 100)]).first()
    assert (s.rows_out, s.rows_removed) == (71, 313)
    assert prune_stats(spark, snapshot, [("c1", "=", None)]).first().skipped_min_max == 3
    for mode in ("batch", "prune", "filter"):
        got = read_snapshot(spark, snapshot, [("c2", "=", 4), ("c1", ">", 200)], mode=mode).agg(F.count("*"), F.sum("c3")).first()
        assert tuple(got) == (46, 59432)


def test_snapshot_errors(spark, snapshot):
    df = rows(spark, 4, "a=id")
    for bad in (0, 63, 100):
        with pytest.raises(ValueError, match="multiple of 64"):
            write_snapshot(df, work_path(spark, "x"), bad, ["a"])
    with pytest.raises(ValueError, match="not int"):
        write_snapshot(df.selectExpr("string(a) AS a"), work_path(spark, "x"))
    with pytest.raises(ValueError, match="mode"):
        read_snapshot(spark, snapshot, mode="fast")


@pytest.fixture(scope="module")
def stream(spark):
    path = work_path(spark, "ipc")
    df = rows(spark, 130, "c1=id", "c2=CASE WHEN id % 7 = 0 THEN NULL ELSE id + 1 END", "c8=id + 8").repartition(3)
    assert export_arrow(df, path, 16) == 130
    return path


@pytest.mark.parametrize("opts", [{}, {"pushdown": True}, {"rows": True}])
def test_arrow_goldens(spark, stream, opts):
    class Fresh:
        def where(self, c):
            return read_arrow(spark, stream, **opts).where(c)

    df = Fresh()
    by = [read_arrow(spark, stream, columns=["c8"], predicates=[("c2", "<", x)]).agg(F.count("*"), F.sum("c8")).first() for x in (10, 100, None)]
    assert [tuple(r) for r in by] == [(7, 85), (84, 4788), (0, None)]
    assert [df.where(c).count() for c in ("c1 < 50", "c1 <= 50", "c1 > 50", "50 <= c1", "true")] == [49, 50, 80, 81, 130]
    assert [tuple(df.where(f"c2 < {x}").agg(F.count("*"), F.sum("c8")).first()) for x in (10, 100)] == [(7, 85), (84, 4788)]


def test_arrow_errors(spark, stream):
    with pytest.raises(ValueError, match="positive"):
        export_arrow(rows(spark, 3, "a=id"), work_path(spark, "x"), 0)
    with pytest.raises(ValueError, match="not int"):
        export_arrow(spark.range(3), work_path(spark, "x"))
    with pytest.raises(PySparkException):
        read_arrow(spark, stream, columns=["nope"]).collect()
    remove_arrow(work_path(spark, "absent"))


def test_registry_and_config(plain):
    r = Registry("operator")
    r.register("keep", lambda df: df)
    with pytest.raises(ValueError, match="already registered"):
        r.register("keep", lambda df: df)
    with pytest.raises(ValueError, match="API version"):
        r.register("new", lambda df: df, api_version=9)
    with pytest.raises(KeyError):
        r.get("gone")
    r.unregister("keep")
    assert r.names() == [] and EngineConfig().set(enable_hash_join=False).join_strategy == "merge"
    with pytest.raises(ValueError):
        EngineConfig(snapshot_mode="other")


def test_counters(spark):
    counted = plan_counters(spark.range(100).where("id % 2 = 0"))
    assert any(n.get("numOutputRows") == 50 for n in counted)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_parameters_are_values(spark):
    df = spark.createDataFrame([(1, "a"), (5, "it's :p {x}"), (9, None)], "v int, t string")
    assert [r.v for r in ops.filter_rows(df, "v > :p", "v < :pmax", args={"p": 1, "pmax": 9}).collect()] == [5]
    assert [r.v for r in ops.filter_rows(df, "t = :t", args={"t": "it's :p {x}"}).collect()] == [5]
    assert [r.v for r in ops.filter_rows(df, "t LIKE '%{x}' AND v > :p", args={"p": 0}).collect()] == [5]
    run = ops.prepared(df, "v >= :lo")
    assert [run(lo=x).count() for x in (1, 6, None)] == [3, 1, 0]


def test_predicates_reach_the_scan(spark):
    from colquery.queries import CATALOGUE

    for name, column in (("scan_range", "l_orderkey"), ("scan_bitmap_and", "l_partkey"), ("scan_bitmap_or", "Or("), ("scan_range_param", "l_orderkey")):
        text = CATALOGUE[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        pushed = next(x for x in text.splitlines() if "PushedFilters" in x)
        assert column in pushed and "l_comment" not in text, name


def test_classes_of_filters():
    from colquery.sources import EXACT, PRUNE_ONLY, UNSUPPORTED, classify

    one, known = ("c1", "<", 5), ["c1", "c2"]
    assert [classify(m, known, predicate=one) for m in ("batch", "prune", "filter")] == [UNSUPPORTED, PRUNE_ONLY, EXACT]
    assert [classify(m, known, text="(c2 + 3) * 2 > 20") for m in ("batch", "prune", "filter")] == [UNSUPPORTED, UNSUPPORTED, EXACT]
    assert [classify("filter", known, text=t) for t in ("c1 + c2 < 3", "c9 = 1", "c1 IS NULL", "c1 < 99999999999")] == [UNSUPPORTED] * 4


def test_filter_mode_filters_in_the_source(spark, snapshot):
    """The plan has no filter above the source in filter mode, and one in prune mode."""
    args = ([("c2", "=", 2), ("c1", ">", 100)],)
    exact = read_snapshot(spark, snapshot, *args, filters=["(c3 + 1) % 5 = 2"])
    want = read_snapshot(spark, snapshot, *args, mode="batch", filters=["(c3 + 1) % 5 = 2"])
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, want.collect())) and exact.count() > 0
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in optimized(exact) and "Filter" in optimized(read_snapshot(spark, snapshot, *args, mode="prune"))
    with pytest.raises(PySparkException):
        read_snapshot(spark, snapshot, filters=["c1 + 2147483647 > 0"]).collect()
    assert read_snapshot(spark, snapshot, [("c1", ">", 9)], filters=["10 / (c1 - 9) > 2"]).count() == 3  # rows that an earlier filter dropped don't divide by zero


def test_switches(spark, snapshot, stream):
    from colquery.sources import compress, read_table

    base = rows(spark, 384, "c1=id", "c2=(id % 4) * 2", "c3=id + 1000")
    scans = lambda config: "snapshot" in read_table(base, snapshot, [("c2", "=", 2)], config=config)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert scans(EngineConfig()) and not scans(EngineConfig(snapshot_enable=False)) and not scans(EngineConfig(enable=False))
    joined = ops.equi_join(base, base.limit(3), [("c1", "c1")], config=EngineConfig(enable_hash_join=False))
    assert "SortMergeJoin" in plan(joined)
    on, off = (read_arrow(spark, stream, columns=["c8"], predicates=[("c2", "<", 10)], config=c) for c in (EngineConfig(), EngineConfig(arrow_pushdown=False, arrow_column_pruning=False)))
    assert sorted(on.collect()) == sorted(off.collect()) and "Filter" in plan(off) and "Filter" not in plan(on).split("== Physical Plan ==")[0].split("== Optimized")[1]
    path = work_path(spark, "compressed")
    assert compress(base, path, 128) > 0 and read_snapshot(spark, path).count() == 384


def test_lazy_decoding(spark, stream):
    """Batches without survivors are never decoded beyond their filter columns."""
    from colquery.sources.arrow_ipc import ArrowReader

    reader = ArrowReader(stream, ["c8"], True, [("c2", "<", 10)])
    seen = []
    whole = reader._decoded
    reader._decoded = lambda fs, p, columns, wanted=None: (seen.append((tuple(columns), wanted)), whole(fs, p, columns, wanted))[1]
    got = [v for part in reader.partitions() for b in reader.read(part) for v in b.column(0).to_pylist()]
    assert sum(got) == 85 and len(got) == 7
    first = [w for c, w in seen if c == ("c8",)]
    assert all(c == ("c2",) for c, w in seen if w is None) and any(not all(w) for w in first)


def test_registries_are_filled(spark, plain):
    from colquery.builtin import operators, register_builtin, sources

    register_builtin()
    assert {"filter", "equi_join", "batches", "group_aggregate"} <= set(operators.names()) and {"arrow", "snapshot"} <= set(sources.names())
    assert operators.apply("filter", plain, "c2 < 10").count() == 7
    with pytest.raises(ValueError, match="does not support"):
        operators.apply("equi_join", plain, 3, [("c1", "c1")])
    with pytest.raises(ValueError, match="does not support"):
        operators.apply("batches", spark.range(3), ops.Int4Map, column="id")


def test_batch_operator_lifecycle(spark):
    import pyarrow as pa

    class Head(ops.UnaryBatch):
        """Counts rows, stops after three, and says so at the end."""

        schema = "id long"

        def open(self):
            self.n = 0

        def process(self, batch):
            self.n += batch.num_rows
            if self.n >= 3:
                raise self.Stop(batch.slice(0, 1))
            return None

        def close(self):
            return pa.RecordBatch.from_pydict({"id": pa.array([-self.n], pa.int64())})

    got = [r.id for r in ops.apply_batches(spark.range(0, 10, 1, 1), Head).collect()]
    assert got == [0, -10]


def test_key_filter_before_a_shuffled_join(spark):
    """A selective side makes a bloom filter that drops probe rows before they are shuffled."""
    path = work_path(spark, "probe")
    spark.range(0, 400_000, 1, 4).selectExpr("id AS k", "id % 1000 AS v").write.parquet(path)
    names = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        big = spark.read.parquet(path)
        joined = ops.equi_join(big, big.where("v = 7"), [("k", "k")])
        assert "might_contain" in plan(joined) and joined.count() == 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_theta_join_is_bounded(spark, monkeypatch):
    from colquery.operators import join

    monkeypatch.setattr(join, "MAX_THETA_ROWS", 5)
    with pytest.raises(ValueError, match="more than 5 rows"):
        ops.theta_join(spark.range(3), spark.range(6), "l.id < r.id")


def most_joined(df):
    """The most rows that a join of the executed plan let out."""
    return max(n.get("numOutputRows", 0) for n in plan_counters(df) if "Join" in n["node"])


@pytest.mark.parametrize("name", ["join_duplicates", "join_one_key", "join_two_keys", "join_three_keys", "join_left", "join_right", "join_full", "join_hash_off", "agg_over_join", "join_scalar_residual", "join_skew",
                                  "join_hint_broadcast", "join_hint_shuffle_hash", "join_hint_merge"])
def test_totals_form_no_pairs(spark, name):
    """A copy of every row makes four times the pairs; joins let out what they did before, and the totals follow."""
    from colquery import queries as catalogue

    sf = "/root/testdata/sf0.001"
    once = catalogue.CATALOGUE[name][0](spark, sf)
    path = work_path(spark, "copied")
    for t in ("orders", "part", "lineitem"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        df.unionAll(df).write.parquet(f"{path}/{t}.parquet")
    twice = catalogue.CATALOGUE[name][0](spark, path)
    assert most_joined(once) == most_joined(twice) > 0
    if name not in ("join_left", "join_right", "join_full"):
        assert sum(r.n for r in twice.collect()) == 4 * sum(r.n for r in once.collect())


def odd_sides(spark):
    left = rows(spark, 400, "k=CASE WHEN id % 11 = 0 THEN NULL ELSE id % 7 * (id % 5) END", "j=id % 2", "v=CASE WHEN id % 9 = 0 THEN NULL ELSE id % 23 - 11 END").unionAll(rows(spark, 3, "k=99", "j=0", "v=NULL"))
    right = rows(spark, 300, "k=CASE WHEN id % 13 = 0 THEN NULL ELSE id % 31 END", "j=id % 3", "v=CASE WHEN id % 4 = 0 THEN NULL ELSE id % 19 - 9 END").unionAll(rows(spark, 2, "k=99", "j=0", "v=5"))
    return left, right


TOTALS = {"n": "*", "a": "l.v", "b": "r.v"}


def pairs_summed(left, right, on, **options):
    return tuple(ops.equi_join(left, right, on, **options).agg(F.expr("count(*)"), F.expr("sum(l.v)"), F.expr("sum(r.v)")).first())


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_totals_equal_those_of_pairs(spark, how):
    left, right = odd_sides(spark)
    for l, r, on in ((left, right, [("k", "k")]), (left, right, [("k", "k"), ("j", "j")]), (left, right.where("v IS NULL"), [("k", "k")]), (left.where("k = 77"), right, [("k", "k")])):
        assert tuple(ops.join_totals(l, r, on, how=how, **TOTALS).first()) == pairs_summed(l, r, on, how=how)


def test_totals_with_residuals_equal_those_of_pairs(spark):
    left, right = odd_sides(spark)
    third = {"m": "v % 3"}
    for l, r, on in ((left, right, [("k", "k"), ("j", "j")]), (left.where("k = 99"), right, [("k", "k")]), (left.where("v = 5"), right.where("v = 5"), [("k", "k")])):
        got = [ops.join_totals(l, r, on, unequal=("v", "v"), **TOTALS), ops.join_totals_below(l, r, on, ("v", "v"), **TOTALS),
               ops.join_totals(l, r, on, left_by=third, right_by=third, residual="(l.m + r.m) % 3 = 0", **TOTALS)]
        want = [pairs_summed(l, r, on, residual=x) for x in ("l.v <> r.v", "l.v < r.v", "(l.v + r.v) % 3 = 0")]
        assert [tuple(x.first()) for x in got] == want


def test_sums_beyond_int4_stay_errors(spark):
    """The residual's int4 sum overflows for one pair only; other keys' extremes don't count."""
    from colquery import queries as catalogue

    third = {"left_by": catalogue._THIRD, "right_by": catalogue._THIRD, "residual": catalogue._THIRD_SUM}
    left = spark.sql("SELECT * FROM VALUES (1, 2147483647), (1, 4), (2, 5), (3, NULL) AS x(k, v)")
    fine = spark.sql("SELECT * FROM VALUES (1, -1), (2, 2147483642), (2, 1), (3, 9) AS x(k, v)")
    on = [("k", "k")]
    assert tuple(ops.join_totals(left, fine, on, **third, **TOTALS).first()) == pairs_summed(left, fine, on, residual="(l.v + r.v) % 3 = 0")
    with pytest.raises(PySparkException):
        ops.join_totals(left, fine.unionAll(spark.sql("SELECT 1, 2")), on, **third, **TOTALS).collect()


def test_totals_beyond_int8_are_errors(spark):
    """9 * 10^12 pairs are no work; a sum of 1.8 * 10^22 is an error, as in SQL."""
    many = spark.range(0, 3_000_000, 1, 8).selectExpr("CAST(1 AS INT) AS k", "CAST(7 AS INT) AS v")
    assert tuple(ops.join_totals(many, many, [("k", "k")], **TOTALS).first()) == (9 * 10**12, 63 * 10**12, 63 * 10**12)
    with pytest.raises(PySparkException):
        ops.join_totals(many.selectExpr("k", "CAST(2000000000 AS INT) AS v"), many, [("k", "k")], **TOTALS).collect()


def chained(o, i, p):
    """The chain by pairs."""
    inner = ops.equi_join(o, i, [("k1", "k1")]).selectExpr("l.v AS v", "r.v AS w")
    return tuple(ops.equi_join(inner, p, [("w", "id")]).agg(F.expr("count(*)"), F.expr("sum(l.v + r.g)")).first())


def test_chain_of_joins_forms_no_pairs(spark, monkeypatch):
    """On repeated and NULL keys and values the chain's totals are those of pairs, but no join lets out more rows than part has; int4 overflow stays an error."""
    from colquery import queries as catalogue

    o = rows(spark, 600, "k1=CASE WHEN id % 10 = 0 THEN NULL ELSE id % 5 END", "v=CASE WHEN id % 7 = 0 THEN NULL ELSE id END")
    i = rows(spark, 90, "k1=CASE WHEN id % 8 = 0 THEN NULL ELSE id % 6 END", "v=CASE WHEN id % 9 = 0 THEN NULL ELSE id % 20 END")
    p = rows(spark, 200, "id=CASE WHEN id % 3 = 0 THEN NULL ELSE id % 40 END", "g=CASE WHEN id % 4 = 0 THEN NULL ELSE id - 100 END")
    sides = {catalogue.JO: o, catalogue.JI: i, catalogue.OI: p}
    monkeypatch.setattr(catalogue, "view", lambda s, d, text: sides[text])
    chain = lambda: catalogue.CATALOGUE["join_chain"][0](spark, "")
    assert tuple(chain().first()) == chained(o, i, p) and most_joined(chain()) <= 90
    sides[catalogue.OI] = p.where("g IS NULL")
    assert tuple(chain().first()) == chained(o, i, p.where("g IS NULL"))
    sides[catalogue.OI] = p.where("false")
    assert tuple(chain().first()) == (0, None)
    sides[catalogue.OI] = p.unionAll(spark.sql("SELECT 7, 2147483600"))
    with pytest.raises(PySparkException):
        chain().collect()


def test_limits_in_many_tasks(spark, plain, monkeypatch):
    """Rows beyond an offset, or up to a far limit, are cut by number and stay sorted; no plan brings them into one task."""
    from colquery import queries as catalogue
    from colquery.operators import limit

    for name in ("limit_huge", "limit_offset_only"):
        df = catalogue.CATALOGUE[name][0](spark, "/root/testdata/sf0.001")
        assert "Limit" not in plan(df)
        ids = [r.id for r in df.collect()]
        assert ids == sorted(ids) and len(ids) > 1000
    monkeypatch.setattr(limit, "MAX_ONE_TASK", 10)
    ties = plain.selectExpr("c1 % 3 AS k", "c1").repartition(5)
    for n, m in ((20, 0), (20, 7), (5, 30), (None, 64), (2**63 - 1, 1), (2**31, None), (500, None), (5, 2**63 - 1)):
        first, last = m or 0, 80 if n is None else min(80, (m or 0) + n)
        assert [r.c1 for r in ops.limit_offset(plain.select("c1"), n, m, order_by="c1").collect()] == list(range(first + 1, last + 1))
        want = sorted(i % 3 for i in range(1, 81))[first:last]
        assert [r.k for r in ops.limit_offset(ties, n, m, order_by="k").collect()] == want
        assert [r.k for r in ops.limit_offset(ties, n, m, order_by=[F.col("k").desc(), "c1"]).collect()] == sorted((i % 3 for i in range(1, 81)), reverse=True)[first:last]
    unordered = plain.selectExpr("map(c1, c1) AS x")  # has no order
    assert len({tuple(r.x) for r in ops.limit_offset(unordered, 30, 25).collect()}) == 30
    assert ops.with_ties(ties, 30, "k").count() == 53 and ops.with_ties(ties, 2**40, "k").count() == 80


def test_far_limits_keep_columns(spark, plain, monkeypatch):
    """Names may repeat or be those the step uses itself; what Parquet cannot hold is cut all the same."""
    from colquery.operators import limit

    monkeypatch.setattr(limit, "MAX_ONE_TASK", 10)
    inner = ["c1", "__row", "__id", "__part", "__at", "__start", "c0"]
    for names in (inner, ["c1", *"xxXxyy"]):
        df = ops.limit_offset(plain.selectExpr("c1", *["c1 + 1"] * 6).toDF(*names), None, 75, order_by="c1")
        assert df.columns == names and [tuple(r) for r in df.collect()] == [(i, *[i + 1] * 6) for i in range(76, 81)]
    sides = plain.alias("l").join(plain.alias("r"), F.expr("l.c1 = r.c1")).select("l.c1", "r.c1")
    assert [tuple(r) for r in ops.limit_offset(sides, 3, 70, order_by="l.c1").collect()] == [(i, i) for i in (71, 72, 73)]
    odd = ops.limit_offset(plain.selectExpr("c1", "named_struct('a', c1, 'A', -c1) AS s", "make_interval(0, 0, 0, c1) AS i"), None, 78, order_by="c1")
    assert [tuple(r) for r in odd.selectExpr("c1", "string(i)").collect()] == [(79, "79 days"), (80, "80 days")]
    with pytest.raises(PySparkException):
        ops.limit_offset(plain, None, 64, order_by="none")


def test_offset_is_written_by_many_tasks(spark, tmp_path):
    """As it was, one task sorted and wrote all rows."""
    import pyarrow.parquet as pq

    from colquery import queries as catalogue

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, skipped in (("limit_offset_only", 64), ("limit_huge", 1)):
            catalogue.CATALOGUE[name][0](spark, "/root/testdata/sf0.01").write.parquet(f"{tmp_path}/{name}")
            parts = [pq.read_table(f, partitioning=None)["id"].to_pylist() for f in sorted(tmp_path.glob(f"{name}/part-*"))]
            want = sorted(pq.read_table("/root/testdata/sf0.01/orders.parquet")["o_orderkey"].to_pylist())[skipped:]
            assert [i for p in parts for i in p] == want and max(map(len, parts)) < len(want) / 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
