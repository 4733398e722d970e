"""Blocked layouts give what one plain window would."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.plans.ordered import bucket_of, fit_width, last_known, running, with_position
from barloom.operators import recursive as re_
from barloom.operators import windows as wi
from barloom.plans import series
from barloom.plans.series import Smooth, columns_step, ema_step, over_series, span_alpha


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(3)
    parts = []
    for sym, n in (("A", 5000), ("B", 37), ("C", 1)):
        ts = pd.date_range("2024-01-01", periods=n, freq="17min") + pd.to_timedelta(
            rng.integers(0, 60, n), unit="s"
        )
        parts.append(pd.DataFrame({"symbol": sym, "ts": ts, "x": rng.normal(100, 20, n).cumsum() / 50}))
    pdf = pd.concat(parts)
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_position_and_running(walk):
    pdf, df = walk
    got = with_position(df).toPandas().sort_values(["symbol", "ts"])
    assert (got["_rn"].values == got.groupby("symbol").cumcount().values + 1).all()
    out = running(df, {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, width=3_600_000_000)
    out = out.toPandas().sort_values(["symbol", "ts"])
    ref = pdf.sort_values(["symbol", "ts"])
    np.testing.assert_allclose(out["s"], ref.groupby("symbol")["x"].cumsum(), rtol=1e-12)
    np.testing.assert_allclose(out["m"], ref.groupby("symbol")["x"].cummax())


def test_backward_and_last_known(walk):
    pdf, df = walk
    holes = df.withColumn("y", F.when(F.pmod(F.hash("ts"), F.lit(10)) == 0, F.col("x")))
    out = last_known(holes, {"p": "y"}, {"n": "y"}, width=3_600_000_000)
    out = out.selectExpr("symbol", "ts", "y", "p.v as p", "n.v as n").toPandas()
    out = out.sort_values(["symbol", "ts"])
    pd.testing.assert_series_equal(out.groupby("symbol")["y"].ffill(), out["p"], check_names=False)
    pd.testing.assert_series_equal(out.groupby("symbol")["y"].bfill(), out["n"], check_names=False)


@pytest.mark.parametrize("block", [50, 700, None])
def test_blocks_equal_plain_window(walk, block):
    _, df = walk
    step = columns_step(
        lambda f: {"a": f.roll(F.avg, "x", 20), "n": f.next_agg(F.max, "x", 5), "l": f.lag("x", 3)},
        back=19,
        ahead=5,
    )
    out = over_series(df, step, block_rows=block)
    assert out.columns == ["symbol", "ts", "x", "a", "n", "l"]
    w = Window.partitionBy("symbol").orderBy("ts")
    plain = df.withColumns(
        {
            "a": F.when(F.count("x").over(w.rowsBetween(-19, 0)) == 20, F.avg("x").over(w.rowsBetween(-19, 0))),
            "n": F.max("x").over(w.rowsBetween(1, 5)),
            "l": F.lag("x", 3).over(w),
        }
    )
    a = out.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    b = plain.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("block", [600, 3000, None])
def test_smoothing_matches_recurrence(walk, block):
    pdf, df = walk
    outs = {
        "e8": Smooth("x", span_alpha(8)),
        "e21": Smooth("x", span_alpha(21)),
        "e50": Smooth("x", span_alpha(50)),
        "r14": Smooth("x", 1 / 14),
        "adj": Smooth("x", span_alpha(12), adjusted=True),
        "sma": Smooth("x", span_alpha(9), sma_seed=9),
        "e200": Smooth("x", span_alpha(200)),
    }
    out = over_series(df, ema_step(outs), block_rows=block)
    out = out.toPandas().sort_values(["symbol", "ts"])
    ref = pdf.sort_values(["symbol", "ts"])
    for sym, g in ref.groupby("symbol"):
        o = out[out.symbol == sym]
        x = g["x"].reset_index(drop=True)
        for name, kw in (
            ("e8", dict(span=8, adjust=False)),
            ("e21", dict(span=21, adjust=False)),
            ("e50", dict(span=50, adjust=False)),
            ("e200", dict(span=200, adjust=False)),
            ("r14", dict(alpha=1 / 14, adjust=False)),
            ("adj", dict(span=12, adjust=True)),
        ):
            np.testing.assert_allclose(o[name], x.ewm(**kw).mean(), rtol=1e-11, err_msg=name)
        seeded = x.copy()
        if len(seeded) >= 9:
            seeded[8] = x[:9].mean()
            seeded[:8] = np.nan
            want = seeded[8:].ewm(span=9, adjust=False).mean()
            np.testing.assert_allclose(o["sma"].values[8:], want, rtol=1e-11)
        assert o["sma"].values[:8].size == 0 or np.isnan(o["sma"].values[:8].astype(float)).all()


@pytest.mark.parametrize("block", [150, 3000, None])
def test_smoothing_over_nulls(spark, walk, block):
    pdf, _ = walk
    rng = np.random.default_rng(8)
    pdf = pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    hole = (rng.random(len(pdf)) < 0.3) | (pdf.groupby("symbol").cumcount() < 2)
    hole |= (pdf.groupby("symbol").cumcount() % 600).between(590, 605)
    pdf["x"] = pdf["x"].where(~hole)
    spans = {"e2": 2, "e3": 3, "e9": 9, "e50": 50, "e200": 200}
    outs = {n: Smooth("x", span_alpha(k)) for n, k in spans.items()}
    outs["adj"] = Smooth("x", span_alpha(12), adjusted=True)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    out = over_series(df, ema_step(outs), block_rows=block).toPandas().sort_values(["symbol", "ts"])
    for sym, g in pdf.groupby("symbol"):
        o = out[out.symbol == sym]
        for name, s in outs.items():
            num = den = 0.0
            want = []
            for v in g["x"]:
                num, den = num * (1 - s.alpha), den * (1 - s.alpha)
                if not np.isnan(v):
                    w = 1.0 if s.adjusted or not want or np.isnan(want[-1]) else s.alpha
                    num, den = num + w * v, den + w
                want.append(num / den if den else np.nan)
            np.testing.assert_allclose(o[name].astype(float), want, rtol=1e-9, err_msg=name)
        np.testing.assert_allclose(o["adj"].astype(float), g["x"].ewm(span=12).mean(), rtol=1e-9)


@pytest.mark.parametrize("block", [400, None])
def test_long_extremes_equal_sliding_frames(spark, block, monkeypatch):
    rng = np.random.default_rng(7)
    n = 1500
    rows = []
    for s, m in (("A", n), ("B", 40)):
        for i in range(m):
            low = None if i in (0, 5, 700) else float(rng.normal())
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), 0.1, (low or 0) + 1.0, low))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, high double, low double")

    def run(limit):
        monkeypatch.setattr(series, "LONG_FRAME", limit)
        steps = [wi.stochastic(200), wi.williams_r(150), wi.swings((30, 180), (30,)), wi.near_extremes(64), wi.recent_range(500)]
        out = over_series(df, *steps, block_rows=block)
        return out.columns, sorted(map(str, out.collect()))

    assert run(10) == run(100_000)


def recurrence(x, alpha, adjusted=False):
    """Weighted mean of the known values, row by row."""
    num = den = 0.0
    out = []
    for v in x:
        num, den = num * (1 - alpha), den * (1 - alpha)
        if not np.isnan(v):
            num, den = num + (alpha if den and not adjusted else 1.0) * v, den + (alpha if den and not adjusted else 1.0)
        # Sums of a long run fade together; their quotient must not.
        if 0 < den < 1e-200:
            num, den = num * 1e200, den * 1e200
        out.append(num / den if den else np.nan)
    return np.array(out)


@pytest.mark.parametrize("block", [700, None])
def test_runs_of_nulls_over_many_blocks(spark, block):
    """3,000 rows missing in 9,000: every indicator equals its row-by-row form, whatever the blocks."""
    n = 9000
    rng = np.random.default_rng(5)
    close = 100 + rng.normal(0, 1, n).cumsum()
    high, low = close + rng.random(n), close - rng.random(n)
    gone = np.zeros(n, dtype=bool)
    gone[:3] = gone[3000:6000] = gone[6005:6900] = True
    bars = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="5min")})
    for c, v in (("close", close), ("high", high), ("low", low)):
        bars[c] = np.where(gone, np.nan, v)
    df = spark.createDataFrame(bars)
    df = df.select("symbol", "ts", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("close", "high", "low")])
    got = over_series(
        df,
        re_.ema("close", (3, 21, 200)),
        re_.ema("close", (12,), adjusted=True, prefix="adj"),
        re_.ema("close", (9,), seed="sma", prefix="sma"),
        re_.macd(),
        re_.rsi((14,)),
        re_.rsi_momentum(),
        re_.atr(),
        re_.adx(),
        re_.distance("ema_21"),
        block_rows=block,
        position="at",
    ).toPandas()
    got = got.sort_values("ts").reset_index(drop=True).astype({c: float for c in got.columns[2:]})
    assert (got["at"].values == np.arange(1, n + 1)).all()

    def same(name, want):
        np.testing.assert_allclose(got[name], want, rtol=1e-8, atol=1e-9, err_msg=name)

    x = bars["close"].values
    for k in (3, 21, 200):
        same(f"ema_{k}", recurrence(x, span_alpha(k)))
    same("adj_12", recurrence(x, span_alpha(12), adjusted=True))
    first = 3 + 8  # nine known rows from the fourth on
    seeded = x.copy()
    seeded[:first], seeded[first] = np.nan, x[3 : first + 1].mean()
    same("sma_9", recurrence(seeded, span_alpha(9)))
    line = recurrence(x, span_alpha(12)) - recurrence(x, span_alpha(26))
    same("macd", line)
    same("macd_signal", recurrence(line, span_alpha(9)))
    diff = np.append(np.nan, np.diff(x))
    gain, loss = np.where(np.isnan(diff), np.nan, np.maximum(diff, 0)), np.where(np.isnan(diff), np.nan, np.maximum(-diff, 0))
    a, b = recurrence(gain, 1 / 14), recurrence(loss, 1 / 14)
    rsi = 100 * a / (a + b)
    same("rsi_14", rsi)
    same("rsi_momentum", rsi - np.append([np.nan] * 3, rsi[:-3]))
    before = np.append(np.nan, x[:-1])
    h, lo = bars["high"].values, bars["low"].values
    spread = np.vstack([h - lo, np.abs(h - before), np.abs(lo - before)])
    tr = np.where(np.isnan(spread).all(axis=0), np.nan, np.nanmax(np.where(np.isnan(spread), -1, spread), axis=0))
    tr[np.isnan(before)] = np.nan
    atr = recurrence(tr, 1 / 14)
    same("atr", atr)
    up, down = np.append(np.nan, np.diff(h)), np.append(np.nan, -np.diff(lo))
    known = ~np.isnan(up + down)
    p = np.where(known, np.where((up > down) & (up > 0), up, 0.0), np.nan)
    m = np.where(known, np.where((down > up) & (down > 0), down, 0.0), np.nan)
    plus, minus = 100 * recurrence(p, 1 / 14) / atr, 100 * recurrence(m, 1 / 14) / atr
    same("plus_di", plus)
    dx = np.nan_to_num(100 * np.abs(plus - minus) / (plus + minus))
    dx[0] = np.nan
    same("adx", recurrence(dx, 1 / 14))
    same("dist", x - recurrence(x, span_alpha(21)))


def test_a_stated_or_proven_absence_of_nulls_is_not_counted(spark, walk):
    _, df = walk
    step = ema_step({"e": Smooth("x", span_alpha(8))})
    asked = over_series(df, step).orderBy("symbol", "ts").collect()
    for gaps in (False, True):
        told = over_series(df, step, gaps=gaps).orderBy("symbol", "ts").collect()
        np.testing.assert_allclose([r.e for r in told], [r.e for r in asked], rtol=1e-11)


def test_one_null_keeps_a_constant(spark):
    rows = [("A", dt.datetime(2024, 1, 1, 0, i), None if i in (0, 1, 5) else 10.0) for i in range(9)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double")
    out = over_series(df, ema_step({"e": Smooth("x", span_alpha(5)), "w": Smooth("x", 1.0)}))
    assert [r.e and round(r.e, 9) for r in out.orderBy("ts").collect()] == [None, None] + [10.0] * 7
    assert [r.w for r in out.orderBy("ts").collect()] == [None, None] + [10.0] * 7


def test_bucket_width_fits_dense_keys(walk):
    pdf, df = walk
    width = fit_width(df, ["symbol"], "ts", limit=20)
    per = df.groupBy("symbol", bucket_of(df, "ts", width).alias("b")).count().agg(F.max("count")).first()[0]
    assert per <= 20 and width < 86_400_000_000
    got = with_position(df, width=width).toPandas().sort_values(["symbol", "ts"])
    assert (got["_rn"].values == got.groupby("symbol").cumcount().values + 1).all()


def test_deepest_fall_in_one_pass_equals_the_running_form(spark):
    rng = np.random.default_rng(12)
    rows = []
    for s, n in (("A", 900), ("B", 3), ("down", 40), (None, 25)):
        for i in range(n):
            v = -1.0 if s == "down" else (None if i % 17 == 0 else float(rng.normal()))
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), v))
    df = spark.createDataFrame(rows, "symbol string, exit_time timestamp, pnl_pct double")
    got = {r.symbol: r.max_drawdown for r in wi.max_drawdown(df).collect()}
    for s in got:
        x = np.array([v for k, _, v in rows if k == s and v is not None]).cumsum()
        assert got[s] == pytest.approx(float((x - np.maximum.accumulate(x)).min()), abs=1e-9)
    scans = wi.max_drawdown(df)._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("LogicalRDD") + scans.count("LocalRelation") == 1
