"""Online indicators, signal votes, trailing stops and drawdown, in event time.

A key keeps a handful of numbers and the rows that the watermark has not passed yet. Rows may arrive in
any order within the delay: they wait in a list state until a timer at their time fires, and then go on in
order, so that the results do not depend on micro-batches. Rows behind the watermark are dropped and
counted in the progress reports. A key whose state is over (a closed position, or no row for ``idle``)
leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.plans.series import span_alpha, wilder_alpha

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Advance = Callable[[pd.DataFrame, "tuple | None"], "tuple[pd.DataFrame, tuple | None]"]


def _milliseconds(t: pd.Series) -> np.ndarray:
    """Whole milliseconds at or after each time."""
    us = t.to_numpy().astype("datetime64[us]").astype(np.int64)
    return -(-us // 1000)


class InOrder(StatefulProcessor):
    """Hands a key's rows to ``advance`` in time order, once the watermark has passed them."""

    def __init__(self, keys, order, columns, advance, out, state, idle_ms):
        self.keys, self.order, self.columns = keys, order, columns
        self.advance, self.out, self.state, self.idle_ms = advance, out, state, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        decl = ", ".join(f"`{c}` {t}" for c, t in self.columns)
        self.waiting = handle.getListState("waiting", decl)
        self.kept = handle.getValueState("kept", self.state)
        self.ends = handle.getValueState("ends", "at bigint")

    def handleInputRows(self, key, rows, timerValues):
        names = [c for c, _ in self.columns]
        new = pd.concat(list(rows), ignore_index=True)[names]
        plain = new.astype(object).where(new.notna(), None)
        plain[self.order] = [t.to_pydatetime() for t in new[self.order]]
        self.waiting.appendList(list(plain.itertuples(index=False, name=None)))
        self.handle.registerTimer(int(_milliseconds(new[self.order]).min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        rows = pd.DataFrame(rows, columns=[c for c, _ in self.columns])
        if not len(rows):  # all rows that came in time are told, and none came since
            if self.ends.exists() and self.ends.get()[0] <= mark:
                self.kept.clear()
                self.ends.clear()
            return
        ripe = _milliseconds(rows[self.order]) <= mark
        rest = rows[~ripe]
        if ripe.any():
            ready = rows[ripe].sort_values(self.order, kind="stable").reset_index(drop=True)
            new, kept = self.advance(ready, tuple(self.kept.get()) if self.kept.exists() else None)
            if kept is None:
                self.kept.clear()
            else:
                self.kept.update(kept)
                if self.idle_ms is not None:
                    end = int(_milliseconds(ready[self.order]).max()) + self.idle_ms
                    self.ends.update((end,))
                    self.handle.registerTimer(end)
            for k, v in zip(self.keys, key, strict=True):
                new.insert(0, k, v)
            new[self.order] = ready[self.order].to_numpy()[: len(new)]
        if len(rest):
            plain = rest.astype(object).where(rest.notna(), None)
            plain[self.order] = [t.to_pydatetime() for t in rest[self.order]]
            self.waiting.put(list(plain.itertuples(index=False, name=None)))
            self.handle.registerTimer(int(_milliseconds(rest[self.order]).min()))
        else:
            self.waiting.clear()
        if ripe.any():
            yield new[[*self.keys, self.order, *self.out]]

    def close(self) -> None:
        pass


def in_event_order(
    stream: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Sequence[str],
    advance: Advance,
    out_columns: str,
    state: str,
    *,
    delay: str | None = "10 minutes",
    idle: str | None = None,
) -> DataFrame:
    """Run ``advance(rows in order, state) -> (new columns, state)`` for each key; a state of None ends
    the key's. ``delay`` is how late rows may come (None: the stream has its watermark already), ``idle``
    after how long without rows a key is forgotten. Works on the store that holds timers."""
    spark = stream.sparkSession
    spark.conf.set(STORE, ROCKS)
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    names = [c.strip().split()[0] for c in out_columns.split(",")]
    held = [(c, types[c]) for c in (order, *columns)]
    key_decl = ", ".join(f"`{k}` {types[k]}" for k in keys)
    source = stream.select(*keys, order, *columns)
    if delay is not None:
        source = source.withWatermark(order, delay)
    return source.groupBy(*keys).transformWithStateInPandas(
        InOrder(list(keys), order, held, advance, names, state, idle_ms),
        f"{key_decl}, `{order}` {types[order]}, {out_columns}",
        "append",
        "eventtime",
    )


def _continue_ema(x: np.ndarray, alpha: float, last: float | None) -> np.ndarray:
    """Recurrence over new values from the last average (or seeded by the first value)."""
    if len(x) == 0:
        return x
    start = x if last is None else np.r_[last, x]
    y = pd.Series(start).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return y if last is None else y[1:]


def online_indicators(
    bars: DataFrame, *, ema_n=21, rsi_n=14, atr_n=14, keys=("symbol",), ts="ts", delay="10 minutes", idle=None
) -> DataFrame:
    """EMA, RSI and ATR of each bar."""
    nan = float("nan")

    def advance(rows, state):
        close = rows["close"].to_numpy(float)
        high, low = rows["high"].to_numpy(float), rows["low"].to_numpy(float)
        ema0, gain0, loss0, atr0, close0 = (None if v is None or np.isnan(v) else v for v in state) if state else (None,) * 5
        ema = _continue_ema(close, span_alpha(ema_n), ema0)
        prev = np.r_[nan if close0 is None else close0, close[:-1]]
        has = ~np.isnan(prev)
        diff = (close - prev)[has]
        tr = np.maximum(high - low, np.maximum(np.abs(high - prev), np.abs(low - prev)))[has]
        g = _continue_ema(np.maximum(diff, 0), wilder_alpha(rsi_n), gain0)
        ls = _continue_ema(np.maximum(-diff, 0), wilder_alpha(rsi_n), loss0)
        at = _continue_ema(tr, wilder_alpha(atr_n), atr0)
        rsi, atr = np.full(len(close), nan), np.full(len(close), nan)
        with np.errstate(invalid="ignore", divide="ignore"):
            rsi[has] = np.where(g + ls > 0, 100 * g / (g + ls), nan)
        atr[has] = at

        def tail(a, old):
            return float(a[-1]) if len(a) else (nan if old is None else old)

        kept = (float(ema[-1]), tail(g, gain0), tail(ls, loss0), tail(at, atr0), float(close[-1]))
        return pd.DataFrame({"ema": ema, "rsi": rsi, "atr": atr}), kept

    return in_event_order(
        bars,
        keys,
        ts,
        ["high", "low", "close"],
        advance,
        "ema double, rsi double, atr double",
        "ema double, gain double, loss double, atr double, close double",
        delay=delay,
        idle=idle,
    )


def online_smoothed_signal(
    signals: DataFrame, n: int = 3, *, keys=("symbol",), ts="ts", majority=0.3, delay="10 minutes", idle=None
) -> DataFrame:
    """Majority of the last n signals; the state is those signals."""

    def advance(rows, state):
        old = [int(v) for v in state[0].split(",") if v] if state else []
        new = rows["signal"].to_numpy(int)
        line = pd.Series(np.r_[old, new].astype(int))
        total = line.rolling(n).sum().to_numpy()[len(old) :]
        vote = np.where(total > n * majority, 1, np.where(total < -n * majority, -1, 0))
        out = np.where(np.isnan(total), new, vote)
        kept = ",".join(str(v) for v in line.to_numpy()[-(n - 1) :]) if n > 1 else ""
        return pd.DataFrame({"signal": new, "smoothed": out.astype(int)}), (kept,)

    return in_event_order(
        signals,
        keys,
        ts,
        ["signal"],
        advance,
        "signal int, smoothed int",
        "recent string",
        delay=delay,
        idle=idle,
    )


def online_trailing_stops(
    prices: DataFrame,
    *,
    pct=0.005,
    keys=("position_id",),
    ts="ts",
    delay="10 minutes",
    idle=None,
    until_hit=False,
) -> DataFrame:
    """Stop after each price, moved only in the position's favour. Rows carry ``position_type``,
    ``price`` and the initial ``stop_price``. With ``until_hit`` a hit closes the position: its later
    rows tell nothing, and only a mark is kept of it (nothing, once ``idle`` is over)."""

    def advance(rows, state):
        long = rows["position_type"].iloc[0] == "long"
        stop0 = state[0] if state else float(rows["stop_price"].iloc[0])
        price = rows["price"].to_numpy(float)
        # Half-up rounding to four digits, as the batch operator does.
        level = np.floor(price * (1 - pct if long else 1 + pct) * 10_000 + 0.5) / 10_000
        line = np.r_[stop0, level]
        stops = (np.maximum if long else np.minimum).accumulate(line)[1:]
        hit = price <= stops if long else price >= stops
        out = pd.DataFrame({"price": price, "trailing_stop": stops, "stop_hit": hit})
        return out, (float(stops[-1]),)

    def advance_until_hit(rows, state):
        if state and np.isinf(state[0]):
            return pd.DataFrame({"price": [], "trailing_stop": [], "stop_hit": []}), state
        out, kept = advance(rows, state)
        at = np.flatnonzero(out["stop_hit"].to_numpy())
        return (out, kept) if not len(at) else (out.iloc[: at[0] + 1].copy(), (float("inf"),))

    return in_event_order(
        prices,
        keys,
        ts,
        ["position_type", "price", "stop_price"],
        advance_until_hit if until_hit else advance,
        "price double, trailing_stop double, stop_hit boolean",
        "stop double",
        delay=delay,
        idle=idle,
    )


def online_drawdown(
    equity: DataFrame,
    *,
    limit=0.10,
    emergency=0.15,
    keys=("portfolio",),
    ts="ts",
    delay="10 minutes",
    idle=None,
) -> DataFrame:
    """Drawdown below the running peak, with its alerts."""

    def advance(rows, state):
        value = rows["value"].to_numpy(float)
        peak = np.maximum.accumulate(np.r_[state[0] if state else -np.inf, value])[1:]
        dd = np.where(peak > 0, (peak - value) / np.where(peak > 0, peak, 1), 0.0)
        out = {"value": value, "drawdown": dd, "limit_breached": dd > limit, "emergency": dd > emergency}
        return pd.DataFrame(out), (float(peak[-1]),)

    return in_event_order(
        equity,
        keys,
        ts,
        ["value"],
        advance,
        "value double, drawdown double, limit_breached boolean, emergency boolean",
        "peak double",
        delay=delay,
        idle=idle,
    )
