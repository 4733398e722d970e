"""Ticks to bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.schema import OHLCV


def ticks_to_bars(
    ticks: DataFrame,
    every: str = "1 hour",
    *,
    value: str = "value",
    ts: str = "ts",
    keys: Sequence[str] = ("symbol",),
    order: Column | str | None = None,
    volume: Column | None = None,
    slide: str | None = None,
    time: str | None = None,
) -> DataFrame:
    """Open, high, low, close and volume per key and window, combined map-side.

    ``order`` breaks ties of equal times (a struct of time and ingest number); volume counts
    ticks unless an expression to sum is given. ``time`` adds the window's event time under that name.
    """
    order = F.col(ts) if order is None else (F.col(order) if isinstance(order, str) else order)
    win = F.window(ts, every, slide) if slide else F.window(ts, every)
    vol = F.count(F.lit(1)).cast("double") if volume is None else F.sum(volume).cast("double")
    bars = ticks.groupBy(*keys, win.alias("_w")).agg(
        F.min_by(value, order).cast("double").alias("open"),
        F.max(value).cast("double").alias("high"),
        F.min(value).cast("double").alias("low"),
        F.max_by(value, order).cast("double").alias("close"),
        vol.alias("volume"),
    )
    event = [F.window_time("_w").alias(time)] if time else []
    return bars.select(*keys, F.col("_w.start").alias("ts"), *OHLCV, *event)


def last_tick(ticks, every="1 hour", *, value="value", ts="ts", keys=("symbol",)) -> DataFrame:
    """Last value per window."""
    return ticks.groupBy(*keys, F.window(ts, every).alias("_w")).agg(
        F.max_by(value, ts).alias("last")
    ).select(*keys, F.col("_w.start").alias("ts"), "last")
