"""Hand-made rows for the edges of cleaning, quantiles and repairs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import cleaning as cl
from barloom.plans import quantiles as qt

T0 = dt.datetime(2024, 1, 1, 9, 0)
MIN = 60_000_000
SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def rows(spark, values, minutes=None):
    minutes = minutes or range(len(values))
    data = [
        ("A", T0 + dt.timedelta(minutes=m), v, v, v, v, v) for m, v in zip(minutes, values, strict=True)
    ]
    return spark.createDataFrame(data, SCHEMA)


def closes(df, col="close"):
    return [r[0] for r in df.orderBy("ts").select(col).collect()]


def test_fills_at_head_middle_and_tail(spark):
    df = rows(spark, [None, 1.0, None, None, 4.0, None])
    assert closes(cl.fill_missing(df, "drop")) == [1.0, 4.0]
    assert closes(cl.fill_missing(df, "forward")) == [1.0, 1.0, 1.0, 4.0, 4.0]
    assert closes(cl.fill_missing(df, "backward")) == [1.0, 1.0, 4.0, 4.0, 4.0]
    assert closes(cl.fill_missing(df, "interpolate")) == [1.0, 2.0, 3.0, 4.0, 4.0]
    assert closes(cl.fill_missing(df, "backward"), "volume") == [0.0, 1.0, 1.0, 1.0, 4.0]


@pytest.mark.parametrize("gap", [2, 3, 4, 5])
def test_gap_lengths(spark, gap):
    """Gaps of L, L+1, 2L and 2L+1 missing bars with L = 2."""
    df = rows(spark, [10.0, 40.0], [0, gap + 1])
    got = closes(cl.fill_time_gaps(df, MIN, 2))
    pdf = pd.Series([10.0] + [np.nan] * gap + [40.0]).ffill(limit=2).interpolate(limit=2).dropna()
    # pandas fills the gap completely up to L; the line starts after the repeated steps.
    line = [10.0, 10.0, 10.0]
    rest = [10 + 30 * j / (gap + 1 - 2) for j in range(1, min(gap, 4) - 1)]
    assert got == pytest.approx(line + rest + [40.0])
    assert len(pdf) == len(got)


def test_off_grid_rows_are_lost_and_short_grids_not_filled(spark):
    df = rows(spark, [1.0, 2.0, 3.0, 4.0, 5.0], [0, 1, 2, 3, 4]).unionByName(
        rows(spark, [9.0], [2]).withColumn("ts", F.col("ts") + F.expr("interval 30 seconds"))
    )
    assert closes(cl.fill_time_gaps(df, MIN, 2)) == [1.0, 2.0, 3.0, 4.0, 5.0]


def walk_cap(x, cap=0.2):
    x = list(x)
    raw = list(x)
    for i in range(1, len(x)):
        if abs(raw[i] / raw[i - 1] - 1) > cap:
            p = x[i - 1]
            x[i] = min(max(x[i], p - p * cap), p + p * cap)
    return x


@pytest.mark.parametrize("block", [None, 3, 8])
def test_chained_caps(spark, block):
    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(0, 0.3, 60).cumsum()) * 100
    x[20:40] = 100 * 1.5 ** (np.arange(20) % 5)
    got = closes(cl.cap_close_moves(rows(spark, [float(v) for v in x]), 0.2, block_rows=block))
    assert got == pytest.approx(walk_cap(x))


def test_caps_chain_over_blocks_that_are_flagged_throughout(spark):
    """Every row moves by more than the cap for dozens of rows: blocks of three are whole runs."""
    rng = np.random.default_rng(6)
    x = [100.0]
    for k in range(90):
        x.append(x[-1] * (rng.choice([0.3, 0.6, 1.6, 3.0]) if k % 40 else 1.05))
    x[70] = -x[70]
    raw = [float(v) for v in x]
    want = walk_cap(raw)
    for block in (3, 7, None):
        assert closes(cl.cap_close_moves(rows(spark, raw), 0.2, block_rows=block)) == pytest.approx(want, rel=1e-9)


def test_keep_first_prefers_lowest_ingest(spark):
    df = rows(spark, [1.0, 2.0], [0, 0]).withColumn("ingest_id", F.when(F.col("close") == 1, 7).otherwise(3))
    assert closes(cl.keep_first(df, ingest="ingest_id")) == [2.0]


@pytest.mark.parametrize("skewed", [False, True])
def test_bracketed_quantiles_are_exact(spark, skewed, monkeypatch):
    monkeypatch.setattr(qt, "SMALL", 100)
    rng = np.random.default_rng(2)
    v = rng.lognormal(0, 3, 30_000)
    if skewed:
        v[:12_000] = 5.0
    pdf = pd.DataFrame({"symbol": np.where(np.arange(30_000) < 25_000, "A", "B"), "x": v, "y": -v})
    df = spark.createDataFrame(pdf).repartition(6)
    got = qt.exact_quantiles(df, {"x": (0.01, 0.25, 0.5, 0.99), "y": (0.75,)}, state_rows=0)
    got = got.toPandas().set_index("symbol")
    for s, g in pdf.groupby("symbol"):
        for i, p in enumerate((0.01, 0.25, 0.5, 0.99)):
            assert got.loc[s, f"q_x_{i}"] == pytest.approx(g.x.quantile(p), rel=1e-12)
        assert got.loc[s, "q_y_0"] == pytest.approx(g.y.quantile(0.75), rel=1e-12)


def test_small_group_quantile_edges(spark):
    df = rows(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    for state in (0, 100):
        q = qt.exact_quantiles(df, {"close": (0.0, 0.25, 0.3, 1.0)}, state_rows=state).first()
        assert [q.q_close_0, q.q_close_1, q.q_close_2, q.q_close_3] == pytest.approx([1, 2, 2.2, 5])


def test_quantiles_do_not_depend_on_size(spark):
    nan = float("nan")
    rows = [("none", None), ("none", None), ("nan", nan), ("mix", 1.0), ("mix", nan), ("mix", None), ("mix", 3.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, close double")
    got = [
        sorted(map(tuple, qt.exact_quantiles(df, {"close": (0.25, 0.5)}, state_rows=k).collect()), key=str)
        for k in (1, 1_000_000)
    ]
    want = [("mix", 1.5, 2.0), ("nan", None, None), ("none", None, None), (None, 2.0, 2.0)]
    assert got[0] == got[1] == sorted(want, key=str)
