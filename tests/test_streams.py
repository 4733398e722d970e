"""Streams in event time: any order of arrival within the delay gives the batch result."""

import datetime as dt
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import recursive as re_
from barloom.plans.series import over_series
from barloom.streaming import bars as sb
from barloom.streaming import state as ss
from barloom.streaming.replay import file_stream, run_to_table

START = dt.datetime(2024, 1, 1)


def minutes(k):
    return START + dt.timedelta(minutes=int(k))


def feed(spark, folder, batches, schema, build):
    """Each batch of rows as several files, taken as one micro-batch; all progress reports."""
    stream, reports = None, []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{folder}/in/part={k}")
        stream = stream or build(file_stream(spark, f"{folder}/in", schema, files=1000))
        reports += run_to_table(stream, f"{folder}/run")
    return spark.read.schema(stream.schema).parquet(f"{folder}/run/out"), reports


@pytest.fixture
def folder(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def test_indicators_of_rows_out_of_order(spark, folder):
    rng = np.random.default_rng(3)
    rows = []
    for s in "AB":
        close = 100 + rng.normal(0, 1, 90).cumsum()
        rows += [(s, minutes(i), float(c), float(c + 1), float(c - rng.random())) for i, c in enumerate(close)]
    schema = "symbol string, ts timestamp, close double, high double, low double"
    arrived = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, 540))
    parts = [arrived[k * 60 : (k + 1) * 60] for k in range(3)]
    out, _ = feed(spark, folder, parts, schema, ss.online_indicators)
    got = out.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    batch = over_series(
        spark.createDataFrame(rows, schema), re_.ema("close", (21,)), re_.rsi((14,)), re_.atr(), gaps=False
    )
    want = batch.toPandas().sort_values(["symbol", "ts"])
    want = want[want.ts <= pd.Timestamp(minutes(89 - 10))].reset_index(drop=True)
    assert len(got) == len(want) and (got.ts == want.ts).all()
    for a, b in (("ema", "ema_21"), ("rsi", "rsi_14"), ("atr", "atr")):
        np.testing.assert_allclose(got[a].astype(float), want[b].astype(float), rtol=1e-9)


def test_rows_behind_the_watermark_are_counted_and_closed_positions_end(spark, folder):
    schema = "position_id string, ts timestamp, price double, position_type string, stop_price double"

    def price(p, k, v):
        return (p, minutes(k), float(v), "long", 90.0)

    batches = [
        [price("p", 0, 100), price("p", 2, 95), price("p", 1, 101), price("q", 0, 100)],
        [price("q", 60, 101)],
        [price("p", 3, 999), price("q", 120, 102)],  # the first is an hour late
        [price("q", 300, 103)],
    ]
    out, reports = feed(
        spark,
        folder,
        batches,
        schema,
        lambda rows: ss.online_trailing_stops(rows, pct=0.02, until_hit=True, idle="2 hours"),
    )
    got = {(r.position_id, r.ts): (r.price, r.trailing_stop, r.stop_hit) for r in out.collect()}
    assert got["p", minutes(1)] == (101.0, 98.98, False)
    assert got["p", minutes(2)] == (95.0, 98.98, True)
    assert ("p", minutes(3)) not in got and got["q", minutes(120)][0] == 102.0
    assert sb.dropped_late_rows(reports) == 1
    # Both keys had no row for two hours when the watermark stood at 290 minutes: q waits with its last.
    states = [op["numRowsTotal"] for r in reports for op in r["stateOperators"]]
    assert states[-1] < max(states)


def test_ticks_to_bars_to_indicators_in_one_stream(spark, folder):
    rng = np.random.default_rng(4)
    rows = [("A", START + dt.timedelta(seconds=int(s)), float(v)) for s, v in zip(range(0, 14400, 97), rng.random(149))]
    schema = "symbol string, ts timestamp, value double"
    arrived = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, 500))

    def build(ticks):
        return ss.online_indicators(sb.stream_bars_in_time(ticks, "10 minutes"), ts="closed", delay=None)

    out, _ = feed(spark, folder, [arrived[:70], arrived[70:]], schema, build)
    got = out.orderBy("closed").toPandas()
    ticks = pd.DataFrame(rows, columns=["s", "ts", "v"]).set_index("ts")["v"]
    close = ticks.resample("10min").last()
    want = close.ewm(span=21, adjust=False).mean().to_numpy()
    assert len(got) >= 20
    np.testing.assert_allclose(got["ema"], want[: len(got)], rtol=1e-12)


def test_late_rows_are_kept_on_the_side(spark, folder):
    schema = "symbol string, ts timestamp, value double"
    sink = sb.late_sink(f"{folder}/late", "10 minutes")
    for k, rows in enumerate([[("A", minutes(60), 1.0)], [("A", minutes(30), 2.0), ("A", minutes(55), 3.0)]]):
        sink(spark.createDataFrame(rows, schema), k)
        sink(spark.createDataFrame(rows, schema), k)  # a repeated batch tells the same
    got = spark.read.schema(schema).parquet(f"{folder}/late/rows").collect()
    assert [(r.ts, r.value) for r in got] == [(minutes(30), 2.0)]
    assert spark.read.parquet(f"{folder}/late/marks").agg(F.max("latest")).first()[0] == minutes(60)
