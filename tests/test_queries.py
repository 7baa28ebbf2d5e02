"""Every query with an SQL twin gives the twin's rows; the others run and give rows."""

import pytest

from canopy.queries import oracle_sql, queries
from tests import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, duck, name):
    ours = compare.spark_rows(queries()[name](spark, SF))
    assert compare.difference(ours, compare.duck_rows(duck, oracle_sql()[name])) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_rows(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(oracle_sql()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_feature_stack_holds_every_pixel(spark, duck):
    n = len(duck.sql("SELECT DISTINCT l_suppkey, l_orderkey % 16 FROM lineitem").fetchall())
    stack = queries()["harmonic_feature_stack"](spark, SF)
    assert len({(r.tile_id, r.row, r.col) for r in stack.select("tile_id", "row", "col").collect()}) == stack.count() == n
    assert {(r.max_iter, r.total) for r in queries()["irls_iterations"](spark, SF).collect()} == {(k, n) for k in (1, 5, 10)}
