"""Every window, label and recursive query gives its SQL twin's rows with tiny blocks, so the
history each step declares is enough."""

import pandas as pd
import pytest

from barloom.catalog import load
from barloom.plans import series
from tests.oracle_check import compare, connect

NAMES = [n for n in load() if n[0] in "wlr" and n[1].isdigit()] + ["v14_dataset_summary", "j3_future_path"]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    """Equal rows; rounding may fall either way on the last digit kept."""
    diff = compare(got, want)
    if diff is None:
        return
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want), diff
    key = [c for c in got.columns if not pd.api.types.is_float_dtype(got[c])]
    x, y = (d[list(got.columns)].sort_values(key).reset_index(drop=True) for d in (got, want))
    for c in key:
        assert (x[c].astype(str) == y[c].astype(str)).all(), diff
    for c in set(got.columns) - set(key):
        pd.testing.assert_series_equal(x[c], y[c].astype(float), rtol=1e-9, atol=2e-6)


@pytest.mark.parametrize("name", NAMES)
def test_small_blocks(spark, sf_dir, con, name, monkeypatch):
    fn, sql = load()[name]
    lay_out = series.lay_out

    def small(df, *, back, ahead, **kw):
        kw["block_rows"] = kw.get("block_rows") or 40
        return lay_out(df, back=back, ahead=ahead, **kw)

    monkeypatch.setattr(series, "lay_out", small)
    got, want = fn(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert_same(got, want)
