"""Tables on which a run is empty, a flag is never set or a price is 0, and streams that end."""

import datetime as dt

import pandas as pd
import pytest

from barloom.catalog import load
from tests.oracle_check import connect
from tests.test_blocks import assert_same

#: Values of one hour; every hour has four ticks, so no trade is quick, and opens at 20 or more.
HOURS = {"zero": (20.0, 0.0, 31.5, 25.0), "lost": (40.0, 22.5, 41.0, 30.25), "flat": (0.0, 0.0, 0.0, 0.0)}


def events(folder, hours):
    rows = [
        (dt.datetime(2024, 1, 1, h, 10 * k + m), s, v)
        for h, name in enumerate(hours)
        for m, s in enumerate(("click", "error"))
        for k, v in enumerate(HOURS[name])
    ]
    df = pd.DataFrame(rows, columns=["ts", "event_type", "value"])
    df["ts"] = df["ts"].astype("datetime64[us]")
    df.insert(0, "event_id", range(len(df)))
    df.to_parquet(f"{folder}/events.parquet")
    return str(folder)


def both(spark, folder, name):
    fn, sql = load()[name]
    got, want = fn(spark, folder).toPandas(), connect(folder).execute(sql).df()
    assert_same(got, want)
    return got


@pytest.mark.parametrize("name", ["a7_compare_runs", "a7_compare_three_runs"])
@pytest.mark.parametrize("hours", [("zero", "lost"), ("zero",), ("lost",)])
def test_runs_without_trades(spark, tmp_path, name, hours):
    got = both(spark, events(tmp_path, hours), name).set_index("metric")
    assert len(got) == 6
    assert got.loc["total_trades", "quick"] == 0 and got.loc["total_trades", "quick_delta"] == -2 * len(hours)
    assert got["quick"].drop("total_trades").isna().all()


def test_flags_never_set(spark, tmp_path):
    got = both(spark, events(tmp_path, ("zero", "lost")), "a8_signal_quality")
    assert sorted(got["signal"]) == ["cheap", "quick"] and (got["n"] == 0).all() and got["win_rate"].isna().all()


@pytest.mark.parametrize("name,column", [("p2_candle_range", "r_low"), ("p4_body_to_range", "eff")])
def test_prices_of_zero(spark, tmp_path, name, column):
    got = both(spark, events(tmp_path, ("zero", "lost", "flat")), name)
    assert got.groupby("ts")[column].count().tolist() == [0, 2, 0]


@pytest.mark.parametrize("name", ["z4_online_indicators", "z6_online_trailing_stops"])
def test_ended_streams_tell_every_bar(spark, tmp_path, name):
    got = both(spark, events(tmp_path, ("zero", "lost", "zero")), name)
    assert len(got) == 6 and got["ts"].max() == pd.Timestamp("2024-01-01 02:00:00")
