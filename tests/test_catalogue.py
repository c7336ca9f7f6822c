"""Every catalogue query equals its oracle on the smallest data."""

import pytest

from colquery.queries import CATALOGUE

from .compare import duck, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_matches_oracle(spark, name):
    query, sql = CATALOGUE[name]
    assert spark_rows(query(spark, SF)) == duck(sql, SF)


def test_whole_tables_are_read(spark):
    """Queries without a filter of their own return all rows."""
    rows = spark.read.parquet(f"{SF}/orders.parquet").count()
    for name in ("add", "sub_left_scalar", "mul", "div", "mod", "neg", "const", "multi_col", "case", "cast_long"):
        assert CATALOGUE[f"project_{name}"][0](spark, SF).count() == rows
    assert CATALOGUE["scalar_subquery"][0](spark, SF).count() == rows
    assert CATALOGUE["set_union_all"][0](spark, SF).count() == 2 * rows
    values = [r.v for r in CATALOGUE["order_by_nulls"][0](spark, SF).collect()]
    assert len(values) == rows and None in values and values == sorted(values, key=lambda v: (v is None, v or 0))


def test_encoding_choice_of_all_columns(spark):
    rows = CATALOGUE["snapshot_encoding_choice"][0](spark, SF).collect()
    assert {r.col for r in rows} == {"id", "v", "g", "s"} and {r.encoding for r in rows} <= {"DELTA8", "DELTA16", "PLAIN"}
