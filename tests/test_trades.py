"""Exit folding and selection against a bar-by-bar walk."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import trades as tr


def make_bars(n=400, seed=1, symbol="A", start="2024-01-01 09:15"):
    rng = np.random.default_rng(seed)
    close = 100 + rng.normal(0, 1, n).cumsum()
    open_ = np.r_[close[0], close[:-1]]
    high = np.maximum(open_, close) + rng.random(n)
    low = np.minimum(open_, close) - rng.random(n)
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": pd.date_range(start, periods=n, freq="15min"),
            "open": open_,
            "high": high,
            "low": low,
            "close": close,
            "volume": 1.0,
            "atr": 1.0 + rng.random(n),
            "signal": (rng.random(n) < 0.4).astype(int),
        }
    )


def walk(pdf, *, stop_atr, target_atr, be=None, start=None, trail=None, on_high=False, hold=20, eod=915):
    """Plain loop over bars with one open trade."""
    out, open_ = [], None
    rows = pdf.to_dict("records")
    for i, r in enumerate(rows):
        if open_ is None:
            if r["signal"] == 1:
                e = r["close"]
                open_ = dict(i=i, e=e, stop=e - stop_atr * r["atr"], tgt=e + target_atr * r["atr"],
                             hi=e, be=False, tr=False)
                open_["risk"] = e - open_["stop"]
            continue
        o = open_
        new = r["close"] > o["hi"]
        o["hi"] = max(o["hi"], r["close"])
        rr = (o["hi"] - o["e"]) / o["risk"] if o["risk"] > 0 else 0
        if be is not None and not o["be"] and rr >= be:
            o["stop"], o["be"] = o["e"], True
        if start is not None and rr >= start:
            o["tr"] = True
        if trail is not None and (o["tr"] or (on_high and new)):
            o["stop"] = max(o["stop"], o["hi"] - trail * r["atr"])
        held, price, reason = i - o["i"], r["close"], None
        if r["high"] >= o["tgt"]:
            price, reason = o["tgt"], "profit_target"
        elif r["low"] <= o["stop"]:
            price, reason = o["stop"], "stop_loss"
        elif held >= hold:
            reason = "max_holding"
        elif eod is not None and r["ts"].hour * 60 + r["ts"].minute >= eod:
            reason = "eod"
        if reason:
            out.append((rows[o["i"]]["ts"], r["ts"], price, reason, held))
            open_ = None
    if open_ is not None:
        r = rows[-1]
        out.append((rows[open_["i"]]["ts"], r["ts"], r["close"], "end_of_data", len(rows) - open_["i"]))
    return out


RULES = {
    "bracket": (dict(stop_atr=1.0, target_atr=2.0), lambda: tr.bracket_rule(1.0, 2.0)),
    "trailing": (
        dict(stop_atr=1.5, target_atr=3.0, be=1.0, start=1.5, trail=1.0, hold=15),
        lambda: tr.trailing_rule(1.5, 3.0, 1.0, 1.5, 1.0, 15),
    ),
    "late_breakeven": (
        dict(stop_atr=1.5, target_atr=4.0, be=1.5, start=0.5, trail=0.5, hold=15),
        lambda: tr.trailing_rule(1.5, 4.0, 1.5, 0.5, 0.5, 15),
    ),
    "ratchet": (
        dict(stop_atr=1.5, target_atr=2.0, trail=0.75, on_high=True),
        lambda: tr.ratchet_rule(1.5, 2.0, 0.75),
    ),
    "long_hold": (
        dict(stop_atr=9.0, target_atr=9.0, hold=40, eod=None),
        lambda: tr.atr_rule(9.0, target_atr=9.0, max_hold=40, eod_minute=None),
    ),
    "no_eod": (
        dict(stop_atr=4.0, target_atr=4.0, hold=20, eod=None),
        lambda: tr.atr_rule(4.0, target_atr=4.0, eod_minute=None),
    ),
}


@pytest.mark.parametrize("name", RULES)
@pytest.mark.parametrize("block", [None, 32])
def test_backtest_equals_walk(spark, name, block):
    kw, rule = RULES[name]
    pdfs = [make_bars(seed=1), make_bars(n=250, seed=2, symbol="B")]
    df = spark.createDataFrame(pd.concat(pdfs)).repartition(3)
    got = tr.backtest(df, rule(), block_rows=block).toPandas().sort_values(["symbol", "entry_time"])
    for pdf in pdfs:
        want = walk(pdf, **kw)
        g = got[got.symbol == pdf.symbol[0]]
        assert list(g.entry_time) == [w[0] for w in want]
        assert list(g.exit_time) == [w[1] for w in want]
        np.testing.assert_allclose(g.exit_price, [w[2] for w in want])
        assert list(g.exit_reason) == [w[3] for w in want]
        assert list(g.candles_held) == [w[4] for w in want]


def test_selection_across_blocks(spark):
    rng = np.random.default_rng(5)
    parts = []
    for sym in ("A", "B"):
        entry = np.sort(rng.choice(np.arange(1, 5000), 1500, replace=False))
        entry = entry[(entry < 1000) | (entry > 1300)]
        parts.append(pd.DataFrame({"symbol": sym, "entry_rn": entry, "exit_rn": entry + rng.integers(1, 40, len(entry))}))
    pdf = pd.concat(parts)
    tr_fan = tr.FAN
    try:
        tr.FAN = 4
        for block in (8, 64, 8192):
            got = tr.select_trades(spark.createDataFrame(pdf), block_rows=block).toPandas()
            for sym, g in pdf.groupby("symbol"):
                want, busy = [], 0
                for e, x in g[["entry_rn", "exit_rn"]].itertuples(index=False):
                    if e > busy:
                        want.append(e)
                        busy = x
                assert sorted(got[got.symbol == sym].entry_rn) == want
    finally:
        tr.FAN = tr_fan


def test_last_bar_candidate_and_open_trade(spark):
    base = dt.datetime(2024, 1, 1, 10, 0)
    rows = [("A", base + dt.timedelta(minutes=i), 10.0, 10.1, 9.9, 10.0, 1.0, 5.0, s) for i, s in enumerate([1, 0, 0, 1])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, atr double, signal int")
    got = tr.backtest(df, tr.atr_rule(1.0, target_atr=1.0, max_hold=3)).orderBy("entry_time").collect()
    # The first trade ends on the last bar, which cannot open another.
    assert [(r.exit_reason, r.candles_held) for r in got] == [("max_holding", 3)]
    only = df.withColumn("signal", (F.minute("ts") == 3).cast("int"))
    (r,) = tr.backtest(only, tr.atr_rule(1.0, target_atr=1.0)).collect()
    assert (r.exit_reason, r.candles_held, r.exit_time) == ("end_of_data", 1, r.entry_time)


def test_horizon_shorter_than_holding_raises(spark):
    df = spark.createDataFrame(make_bars(seed=1))
    with pytest.raises(ValueError, match="shorter"):
        tr.backtest(df, tr.atr_rule(1.0, target_atr=1.0, max_hold=40), horizon=20)
    rule = tr.atr_rule(9.0, target_atr=9.0, max_hold=F.col("hold"), eod_minute=None)
    grid = tr.parameter_grid(spark, hold=[5, 40])
    rows = tr.sweep_trades(df, grid, rule, F.col("signal") == 1).toPandas()
    longest = rows[rows.exit_reason == "max_holding"].groupby("config_id").candles_held.max()
    assert longest.to_dict() == {0: 5, 1: 40}
