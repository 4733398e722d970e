"""Registered queries against their SQL twins (window, label and recursive ones: test_blocks)."""

import pytest

from barloom.catalog import load
from tests.oracle_check import connect
from tests.test_blocks import NAMES, assert_same

OTHERS = [n for n, (_, sql) in load().items() if sql is not None and n not in NAMES]
ROWS_ONLY = [n for n, (_, sql) in load().items() if sql is None]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", OTHERS)
def test_matches_sql(spark, sf_dir, con, name):
    fn, sql = load()[name]
    assert_same(fn(spark, sf_dir).toPandas(), con.execute(sql).df())


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, sf_dir, name):
    assert load()[name][0](spark, sf_dir).count() > 0


def test_late_rows_are_kept_apart(spark, sf_dir):
    """Every tick is in a bar, among the late ones, or in a bar that the watermark has not closed."""
    rows = load()["z3_late_rows"][0](spark, sf_dir).collect()
    total = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    kept, late = sum(r.kept_ticks for r in rows), sum(r.late_ticks for r in rows)
    assert kept > 0 and late > 0 and total - 50 < kept + late <= total


def test_names_and_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
