"""Long horizons: first touches from chunk extremes against a scan of every path."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import labels as la
from barloom.plans.barriers import Touch, first_touches
from barloom.plans.series import over_series


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s, n in (("A", 900), ("B", 37), (None, 120)):
        close = 100 + rng.normal(0, 1, n).cumsum()
        for i, c in enumerate(close):
            high = None if i % 29 == 3 else float(c + rng.random())
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), float(c), high, float(c - rng.random())))
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, high double, low double")
    # The first level moves with the row; null levels are never reached.
    top = F.when(F.minute("ts") != 25, F.col("close") + 4)
    return rows, frame.withColumns({"top": top, "bottom": F.col("close") - 3})


@pytest.mark.parametrize("horizon,start,step", [(300, 1, None), (50, 3, 4), (7, 1, 64), (2000, 5, 9)])
def test_touches_equal_a_scan(walk, horizon, start, step):
    rows, frame = walk
    touches = {"up": Touch("high", "top", True), "dn": Touch("low", "bottom", False)}
    got = {(r.symbol, r.ts): (r.up, r.dn) for r in first_touches(frame, touches, horizon, start=start, step=step).collect()}
    assert len(got) == len(rows)
    for s in ("A", "B", None):
        own = [r for r in rows if r[0] == s]
        for i, r in enumerate(own):
            path = list(enumerate(own[i + start : i + horizon + 1], start))
            up = next((k for k, b in path if r[1].minute != 25 and b[3] is not None and b[3] >= r[2] + 4), None)
            dn = next((k for k, b in path if b[4] <= r[2] - 3), None)
            assert got[s, r[1]] == (up, dn)


def test_far_barrier_equals_the_path_form(spark, walk):
    _, frame = walk
    rows = frame.drop("top", "bottom").withColumn("atr", F.lit(1.5)).where("symbol IS NOT NULL")
    for tail in (False, True):
        near = over_series(rows, la.triple_barrier(40, 2.0, 1.0, keep_tail=tail))
        far = la.triple_barrier_far(rows, 40, 2.0, 1.0, keep_tail=tail, step=6)
        assert far.columns == near.columns
        assert sorted(map(tuple, far.collect())) == sorted(map(tuple, near.collect()))
