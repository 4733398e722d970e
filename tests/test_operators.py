"""Exact values and error paths of risk, signal, metric and source operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import cleaning as cl
from barloom.operators import metrics as mt
from barloom.operators import models as md
from barloom.operators import risk as rk
from barloom.operators import signals as sg
from barloom.operators import splits as sp
from barloom.plans.series import over_series
from barloom.sources import files

T0 = dt.datetime(2024, 1, 1, 10, 0)


def one(df):
    return df.collect()[0]


def test_position_size_values(spark):
    df = spark.createDataFrame([(100.0, 0.8, 10_000.0, 2.0)], "price double, confidence double, portfolio_value double, atr double")
    r = one(df.select(rk.position_size().alias("pct"), rk.position_size(method="atr").alias("atr")))
    assert r.pct == 10_000 * 0.02 * 0.8 / 100
    assert r.atr == 1.6
    low = one(df.withColumn("confidence", F.lit(0.1)).select(rk.position_size().alias("s")))
    assert low.s == 1.0
    with pytest.raises(Exception, match="positive"):
        df.withColumn("price", F.lit(0.0)).select(rk.position_size()).collect()


def test_stop_and_profit_prices(spark):
    df = spark.createDataFrame([(100.0, "long", 2.0), (100.0, "short", 2.0)], "entry_price double, position_type string, atr double")
    df = df.withColumn("stop_price", rk.stop_price())
    got = df.select("stop_price", rk.profit_price(), rk.stop_price(method="atr"), rk.profit_price(method="rr")).collect()
    assert [tuple(r) for r in got] == [(99.0, 102.0, 96.0, 102.0), (101.0, 98.0, 104.0, 98.0)]
    with pytest.raises(ValueError):
        rk.stop_price(method="other")


def test_trailing_stop_never_retreats(spark):
    rows = [("p", T0 + dt.timedelta(minutes=i), p, "long", 98.0) for i, p in enumerate([100.0, 110.0, 105.0, 120.0])]
    df = spark.createDataFrame(rows, "position_id string, ts timestamp, price double, position_type string, stop_price double")
    got = [r.trailing_stop for r in rk.trailing_stops(df, pct=0.01).orderBy("ts").collect()]
    assert got == [99.0, 108.9, 108.9, 118.8]


def test_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    r = one(mt.with_rates(mt.with_scores(mt.confusion(df))))
    assert (r.precision, r.recall, r.f1, r.sensitivity, r.ppv, r.specificity) == (0, 0, 0, 0, 0, 1)
    scored = df.withColumn("probability", F.lit(0.5))
    assert one(mt.roc_auc(scored)).roc_auc is None


def test_smoothing_passes_through_until_full(spark):
    rows = [("A", T0 + dt.timedelta(minutes=i), s) for i, s in enumerate([1, -1, 1, 1, 0, -1, -1])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, signal int")
    got = [r.smoothed for r in over_series(df, sg.smoothed_signal()).orderBy("ts").collect()]
    assert got == [1, -1, 1, 1, 1, 0, -1]


def test_profit_factor_without_losses(spark):
    df = spark.createDataFrame([(1.0, 1, 2)], "pnl_pct double, win int, candles_held int")
    assert one(mt.trade_metrics(df)).profit_factor == float("inf")
    assert one(mt.trade_metrics(df, no_loss=0.0)).profit_factor == 0.0


def test_walk_forward_never_overlaps(spark):
    rows = [("A", T0 + dt.timedelta(hours=i), i % 2) for i in range(103)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, label int")
    for r in sp.walk_forward_folds(df, 4).groupBy("fold").agg(
        F.max(F.when(F.col("role") != "test", F.col("ts"))).alias("a"),
        F.min(F.when(F.col("role") == "test", F.col("ts"))).alias("b"),
    ).collect():
        assert r.a < r.b


def test_csv_with_odd_header(spark, tmp_path):
    p = tmp_path / "ABC_5min.csv"
    p.write_text("Date;O;HIGH;low;Close;Vol\n2024-01-02 09:15:00+05:30;1;3;0.5;2;10\n2024-01-01 09:15:00+05:30;1;2;1;x;\n")
    rows = files.load_bars(spark, str(tmp_path), "ABC", "5min").collect()
    assert [r.symbol for r in rows] == ["ABC", "ABC"]
    assert rows[0].close is None and rows[0].volume is None and rows[1].volume == 10.0
    assert rows[1].ts == dt.datetime(2024, 1, 2, 3, 45)
    with pytest.raises(files.BarFileError):
        files.load_bars(spark, str(tmp_path), "NONE", "5min")
    (tmp_path / "bad_5min.csv").write_text("a,b,c,d,e,f\n1,2,3,4,5,6\n")
    with pytest.raises(files.BarFileError, match="missing"):
        files.load_bars(spark, str(tmp_path), "bad", "5min")


def test_text_lines(spark):
    lines = ["2023-01-09 13:10:00+05:30 1235.7 1235.8 1233 1233.6 131024", "", "too short", "2023-01-09 13:15:00+05:30 1 2 3 4"]
    df = files.parse_bar_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = df.orderBy("ts").collect()
    assert len(rows) == 2 and rows[0].volume == 131024 and rows[1].volume is None
    assert rows[0].ts == dt.datetime(2023, 1, 9, 7, 40)


def test_null_keys_keep_their_rows(spark):
    rows = [(None, T0 + dt.timedelta(days=i), float(i)) for i in range(5)] + [("A", T0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    from barloom.plans.ordered import with_position

    got = with_position(df).orderBy("symbol", "ts").collect()
    assert [r._rn for r in got] == [1, 2, 3, 4, 5, 1]


def test_auc_of_crowded_and_wide_scores(spark):
    rng = np.random.default_rng(4)
    for scores in (10.0 ** -rng.uniform(4, 9, 3000), rng.normal(50, 30, 3000).round(1), np.full(3000, 7.0)):
        label = (rng.random(3000) < 0.3).astype(int)
        df = spark.createDataFrame(pd.DataFrame({"label": label, "probability": scores}))
        pos, neg = scores[label == 1], scores[label == 0]
        want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
        assert mt.roc_auc(df).first().roc_auc == pytest.approx(want)
        order = np.unique(scores)[::-1]
        tp = np.array([(pos >= s).sum() for s in order])
        fp = np.array([(neg >= s).sum() for s in order])
        gain = np.diff(tp, prepend=0) / len(pos) * tp / (tp + fp)
        assert mt.average_precision(df).first().average_precision == pytest.approx(gain.sum())


def test_every_row_is_scored(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.normal(size=300)})
    pdf["label"] = (pdf.a + pdf.b > 0).astype(int)
    df = spark.createDataFrame(pdf)
    model = md.fit(md.balanced(df), ["a", "b"], "forest", weight="weight", numTrees=10, maxDepth=3)
    holes = df.withColumns({"a": F.when(F.col("a") < 1, F.col("a")), "b": F.when(F.col("b") > -1, F.col("b")).otherwise(float("nan"))})
    out = md.score(model, holes.withColumn("weight", F.lit(1.0))).toPandas()
    whole = (pdf.a < 1) & (pdf.b > -1)
    assert len(out) == 300 and out.probability.notna().sum() == whole.sum() == out.prediction.notna().sum()
    assert "weight" not in out


def test_violations_of_half_an_hour(spark):
    now = dt.datetime(2024, 1, 1, 12, 0)
    df = spark.createDataFrame([(m, now - dt.timedelta(minutes=m)) for m in (10, 29, 31, 75, 95)], "m int, ts timestamp")
    got = lambda h: sorted(r.m for r in rk.recent_violations(df, F.lit(now), h).collect())
    assert got(0.5) == [10, 29] and got(1.5) == [10, 29, 31, 75]


def test_first_of_duplicates_needs_an_order(spark):
    df = spark.createDataFrame([("A", 1, 2.0, 5), ("A", 1, 1.0, 4), ("B", 1, None, 1)], "symbol string, ts int, close double, n int")
    with pytest.raises(ValueError, match="first"):
        cl.keep_first(df)
    assert sorted((r.symbol, r.close) for r in cl.keep_first(df, ingest="n").collect()) == [("A", 1.0), ("B", None)]


def test_files_of_one_folder_keep_their_own_layout(spark, tmp_path):
    (tmp_path / "A_5min.csv").write_text("Date;Open;High;Low;Close;Volume\n2024-01-01 09:15:00;1;2;0.5;1.5;10\n")
    (tmp_path / "B_5min.csv").write_text("timestamp,o,h,l,c,vol\n2024-01-01 09:20:00,3,4,2.5,3.5,20\n")
    (tmp_path / "C_5min.csv").write_bytes(
        "datetime\topen\thigh\tlow\tclose\tvolume\tnote\n2024-01-01 09:25:00\t5\t6\t4\t5.5\t30\tcafé\n".encode("latin-1")
    )
    rows = files.read_bar_csv(spark, str(tmp_path)).orderBy("symbol").collect()
    assert [(r.symbol, r.close, r.volume) for r in rows] == [("A", 1.5, 10.0), ("B", 3.5, 20.0), ("C", 5.5, 30.0)]
    assert {x.encoding for x in files.detect_layouts(spark, str(tmp_path))} == {"UTF-8", "ISO-8859-1"}
    (tmp_path / "D_5min.csv").write_text("nothing here\n1\n")
    with pytest.raises(files.BarFileError, match="D_5min"):
        files.read_bar_csv(spark, str(tmp_path))
