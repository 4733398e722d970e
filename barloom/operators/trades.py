"""Trades from signals: resolve every candidate's exit on its own, then keep the ones that do not
overlap an accepted trade.

Exits look at a bounded number of bars ahead, so they are a forward frame folded by a higher-order
function inside the JVM. Selection is sequential by nature; it runs on candidates only, in blocks,
and blocks are linked by the number of rows a trade can reach into the next one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import EOD_MINUTE, div, minute_of_day
from barloom.operators.metrics import trade_metrics
from barloom.plans.barriers import path
from barloom.plans.ordered import null_safe_join
from barloom.plans.series import Step, over_series
from barloom.session import durable

BLOCK = 8192
FAN = 1024


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


@dataclass(frozen=True)
class ExitRule:
    """When a long trade ends. Numbers or Columns (a parameter grid) may be given.

    ``stop`` and ``target`` are prices as Columns over the entry row. From each later bar on, the
    order is: target, stop, ``max_hold`` bars, first bar at or after ``eod_minute``; at the end of
    the data the last close counts. ``breakeven_rr`` moves the stop to the entry once the highest
    close gained that many risks, ``trail_start_rr`` starts trailing ``trail_atr`` average ranges
    below it; ``trail_on_high`` trails only on bars that set a new highest close.
    """

    stop: Column
    target: Column
    max_hold: Column | int = 20
    breakeven_rr: Column | float | None = None
    trail_start_rr: Column | float | None = None
    trail_atr: Column | float | None = None
    trail_on_high: bool = False
    eod_minute: int | None = EOD_MINUTE


def fixed_rule(profit: float = 0.005, loss: float = 0.003, **kw) -> ExitRule:
    e = F.col("close")
    return ExitRule(stop=e * (1 - loss), target=e * (1 + profit), **kw)


def atr_rule(stop_atr=1.5, profit: float | None = 0.005, target_atr=None, **kw) -> ExitRule:
    """Stop in average ranges; target in percent or in average ranges."""
    e, a = F.col("close"), F.col("atr")
    target = e * (1 + profit) if target_atr is None else e + a * _c(target_atr)
    return ExitRule(stop=e - a * _c(stop_atr), target=target, **kw)


def trailing_rule(stop_atr=1.5, target_atr=2.0, breakeven_rr=1.0, trail_start_rr=1.5, trail_atr=1.0, max_hold=15, **kw):
    return replace(
        atr_rule(stop_atr, target_atr=target_atr, max_hold=max_hold, **kw),
        breakeven_rr=breakeven_rr,
        trail_start_rr=trail_start_rr,
        trail_atr=trail_atr,
    )


def tight_rule(**kw) -> ExitRule:
    return trailing_rule(**{**dict(breakeven_rr=0.5, trail_start_rr=1.0, trail_atr=0.5, max_hold=15), **kw})


def ratchet_rule(stop_atr=1.5, target_atr=1.0, trail_atr=0.75, max_hold=20, **kw) -> ExitRule:
    """Trailing from the start on new highs. Of several ascending targets only the lowest can be
    reached, since it closes the trade."""
    return replace(
        atr_rule(stop_atr, target_atr=target_atr, max_hold=max_hold, **kw),
        trail_atr=trail_atr,
        trail_on_high=True,
    )


def bracket_rule(stop_atr=1.0, target_atr=2.0, **kw) -> ExitRule:
    return atr_rule(stop_atr, target_atr=target_atr, **kw)


def swing_stop(buffer=0.2, floor=3.0, swing="swing_low_10", atr="atr") -> Column:
    """Swing low less a buffer, but no further than ``floor`` average ranges."""
    return F.greatest(
        F.col(swing) - F.col(atr) * _c(buffer), F.col("close") - F.col(atr) * _c(floor)
    )


def swing_rule(rr=1.5, buffer=0.2, floor=3.0, **kw) -> ExitRule:
    stop = swing_stop(buffer, floor)
    return ExitRule(stop=stop, target=F.col("close") + (F.col("close") - stop) * _c(rr), **kw)


def entry_path(horizon: int, atr: str | None = "atr", ts="ts") -> Step:
    """Adds the next bars of every row, and its row number."""

    def build(df, f):
        minute = minute_of_day(ts)
        df = df.withColumns({"_m": minute, "_a": F.col(atr) if atr else F.lit(0.0)})
        cols = ("high", "low", "close", "_a", "_m", ts, "_rn")
        return df.withColumns({"_path": path(f, cols, horizon), "_entry_rn": f.rn}).drop("_m", "_a")

    return Step(build, 0, horizon, "entry_path")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.transform(F.array(value), body)[0]


def fold_exit(rule: ExitRule, stop: Column, target: Column, entry: Column) -> Column:
    """State after walking the path; ``k`` is 0 when nothing ended the trade."""
    risk = entry - stop
    hold = rule.max_hold if isinstance(rule.max_hold, Column) else F.lit(rule.max_hold)
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def state(n, k, price, reason, stop_, high, be, trail):
        return F.struct(
            n.cast("int").alias("n"),
            k.cast("int").alias("k"),
            price.alias("price"),
            reason.alias("reason"),
            stop_.alias("stop"),
            high.alias("high"),
            be.alias("be"),
            trail.alias("trail"),
        )

    zero = state(F.lit(0), F.lit(0), null_d, null_s, stop, entry, F.lit(False), F.lit(False))

    def gained(high):
        return F.when(risk > 0, (high - entry) / risk).otherwise(0.0)

    def walk(acc, b):
        def with_high(h):
            be, trail, s = acc["be"], acc["trail"], acc["stop"]
            if rule.breakeven_rr is not None:
                now = gained(h) >= _c(rule.breakeven_rr)
                s = F.when(~be & now, entry).otherwise(s)
                be = be | now
            if rule.trail_start_rr is not None:
                trail = trail | (gained(h) >= _c(rule.trail_start_rr))
            elif rule.trail_on_high:
                trail = b["close"] > acc["high"]
            moved = F.struct(s.alias("s"), be.alias("be"), trail.alias("tr"))
            return _let(moved, lambda m: with_stop(h, m))

        def with_stop(h, m):
            s = m["s"]
            if rule.trail_atr is not None:
                lifted = h - b["_a"] * _c(rule.trail_atr)
                s = F.when(m["tr"] & (lifted > s), lifted).otherwise(s)
            return _let(F.struct(s.alias("s")), lambda x: ended(h, m, x["s"]))

        def ended(h, m, s):
            n = acc["n"] + 1
            reason = F.when(b["high"] >= target, "profit_target").when(b["low"] <= s, "stop_loss")
            reason = reason.when(n >= hold, "max_holding")
            if rule.eod_minute is not None:
                reason = reason.when(b["_m"] >= rule.eod_minute, "eod")
            return _let(
                F.struct(reason.alias("r")),
                lambda r: state(
                    n,
                    F.when(r["r"].isNotNull(), n).otherwise(0),
                    F.when(r["r"] == "profit_target", target)
                    .when(r["r"] == "stop_loss", s)
                    .otherwise(b["close"]),
                    r["r"],
                    s,
                    h,
                    m["be"],
                    m["tr"],
                ),
            )

        step = _let(F.greatest(acc["high"], b["close"]), with_high)
        return F.when(acc["k"] > 0, acc).otherwise(step)

    return F.aggregate("_path", zero, walk)


def resolve_exits(
    candidates: DataFrame,
    rule: ExitRule,
    *,
    keys: Sequence[str] = ("symbol",),
    ts="ts",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One trade row per candidate (rows with ``_path`` from ``entry_path``)."""
    df = candidates.withColumns({"_stop": rule.stop, "_target": rule.target})
    entry = F.col("close")
    df = df.withColumn("_x", fold_exit(rule, F.col("_stop"), F.col("_target"), entry))
    x, n = F.col("_x"), F.size("_path")
    done = x["k"] > 0
    last = F.when(n > 0, F.element_at("_path", F.when(done, x["k"]).when(n > 0, n).otherwise(1)))
    df = df.withColumn("_b", last)
    price = F.when(done, x["price"]).otherwise(F.coalesce(F.col("_b.close"), entry))
    risk = entry - F.col("_stop")
    points = price - entry
    return df.select(
        *keys,
        *keep,
        F.col(ts).alias("entry_time"),
        entry.alias("entry_price"),
        F.coalesce(F.col(f"_b.{ts}"), F.col(ts)).alias("exit_time"),
        price.alias("exit_price"),
        F.coalesce(x["reason"], F.lit("end_of_data")).alias("exit_reason"),
        (div(points, entry) * 100).alias("pnl_pct"),
        points.alias("pnl_points"),
        F.when(risk > 0, points / risk).otherwise(0.0).alias("pnl_r"),
        F.when(done, x["k"]).otherwise(n + 1).cast("int").alias("candles_held"),
        (points > 0).cast("int").alias("win"),
        (div(x["stop"] - entry, entry) * 100).alias("stop_loss_pct"),
        x["high"].alias("highest_price"),
        F.when(risk > 0, (x["high"] - entry) / risk).otherwise(0.0).alias("max_rr_reached"),
        x["be"].alias("breakeven_triggered"),
        x["trail"].alias("trailing_triggered"),
        F.col("_entry_rn").alias("entry_rn"),
        F.coalesce(F.col("_b._rn"), F.col("_entry_rn")).alias("exit_rn"),
    )


# ------------------------------------------------------------------------------- selection


def _walk(entry: np.ndarray, exit_: np.ndarray, busy: int) -> np.ndarray:
    """Places accepted when rows up to ``busy`` are taken; entries are sorted."""
    nxt = np.searchsorted(entry, exit_, side="right")
    i = int(np.searchsorted(entry, busy, side="right"))
    taken = []
    while i < len(entry):
        taken.append(i)
        i = int(nxt[i])
    return np.asarray(taken, dtype=int)


def _transfer(entry: np.ndarray, exit_: np.ndarray, start: int, reach: int, rows: int) -> list[int]:
    """For each number of taken rows at the block's start, how many it takes of the next block."""
    nxt = np.searchsorted(entry, exit_, side="right")
    over = np.maximum(exit_ - (start + rows), 0)
    out = np.zeros(len(entry) + 1, dtype=int)
    for i in range(len(entry) - 1, -1, -1):
        out[i] = over[i] if nxt[i] == len(entry) else out[nxt[i]]
    busy = np.arange(reach + 1)
    first = np.searchsorted(entry, start + busy, side="right")
    # Taken rows that outlast the whole block (short blocks) carry on when nothing is accepted.
    return np.where(first == len(entry), np.maximum(busy - rows, 0), out[first]).tolist()


def select_trades(
    trades: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    block_rows: int = BLOCK,
) -> DataFrame:
    """Trades whose entry lies after the exit row of the last accepted one (a bar that closes a
    trade cannot open one).

    Where every series fits one block, blocks are walked directly. Otherwise each block yields
    the map from rows taken at its start to rows taken of the next block, maps are composed over
    ``FAN`` blocks and then over those, and each block is walked from the state it really gets.
    """
    keys = list(keys)
    rows = durable(trades.withColumn("_blk", F.floor((F.col("entry_rn") - 1) / block_rows)))
    top, reach = rows.agg(
        F.max("_blk"), F.max(F.col("exit_rn") - F.col("entry_rn"))
    ).first()
    block = [*keys, "_blk"]

    def accept(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_rn")
        busy = pdf["_blk"].iloc[0] * block_rows + int(pdf["_in"].iloc[0])
        pick = _walk(pdf["entry_rn"].to_numpy(), pdf["exit_rn"].to_numpy(), busy)
        return pdf.iloc[pick][[*keys, "entry_rn"]]

    # Only row numbers go through Python; the trades themselves are picked by a semi join.
    slim = rows.select(*block, "entry_rn", "exit_rn")
    if not top:
        state = slim.withColumn("_in", F.lit(0))
    else:
        state = null_safe_join(
            slim, _block_states(slim, keys, block_rows, int(reach or 0)), block, "inner"
        )
    kept = [*keys, "entry_rn"]
    picked = state.groupBy(*block).applyInPandas(accept, state.select(*kept).schema)
    return null_safe_join(rows, picked, kept, "left_semi").select(*trades.columns)


def _block_states(slim, keys, block_rows: int, reach: int) -> DataFrame:
    """Rows already taken at the start of every block that holds candidates."""
    block = [*keys, "_blk"]
    types = {f.name: f.dataType.simpleString() for f in slim.schema}
    decl = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("entry_rn")
        t = _transfer(
            pdf["entry_rn"].to_numpy(),
            pdf["exit_rn"].to_numpy(),
            int(pdf["_blk"].iloc[0]) * block_rows,
            reach,
            block_rows,
        )
        return pdf[block].head(1).assign(_t=[t])

    maps = slim.groupBy(*block).applyInPandas(transfer, f"{decl}, _blk bigint, _t array<bigint>")
    maps = durable(maps.withColumn("_sup", F.floor(F.col("_blk") / FAN)))

    def idle(state: int, n: int) -> int:
        """Blocks without candidates only let taken rows run out."""
        return max(state - n * block_rows, 0)

    def run(pdf, start, state, place):
        """States at each row's start and after the last one, walking from block ``start``."""
        seen, at = [], start
        for blk, t in zip(pdf[place], pdf["_t"], strict=True):
            state = idle(state, int(blk) - at)
            seen.append(state)
            state, at = int(t[state]), int(blk) + 1
        return seen, state, at

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        first = int(pdf["_sup"].iloc[0]) * FAN
        ends = []
        for s in range(reach + 1):
            _, state, at = run(pdf, first, s, "_blk")
            ends.append(idle(state, first + FAN - at))
        return pdf[[*keys, "_sup"]].head(1).assign(_t=[ends])

    supers = maps.groupBy(*keys, "_sup").applyInPandas(
        compose, f"{decl}, _sup bigint, _t array<bigint>"
    )

    def top_states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_sup")
        seen, state, at = [], 0, 0
        for sup, t in zip(pdf["_sup"], pdf["_t"], strict=True):
            state = idle(state, (int(sup) - at) * FAN)
            seen.append(state)
            state, at = int(t[state]), int(sup) + 1
        return pdf[[*keys, "_sup"]].assign(_start=seen)

    starts = supers.groupBy(*keys).applyInPandas(top_states, f"{decl}, _sup bigint, _start bigint")
    linked = null_safe_join(maps, starts, [*keys, "_sup"], "inner")

    def block_states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        first = int(pdf["_sup"].iloc[0]) * FAN
        seen, _, _ = run(pdf, first, int(pdf["_start"].iloc[0]), "_blk")
        return pdf[block].assign(_in=seen)

    return linked.groupBy(*keys, "_sup").applyInPandas(
        block_states, f"{decl}, _blk bigint, _in bigint"
    )


def reach(rule: ExitRule, rows: DataFrame, horizon: int | None) -> int:
    """Bars that exits may look ahead: the rule's longest holding time over ``rows`` (the grid or
    the bars), read once where it is a Column. A shorter ``horizon`` would cut trades and raises."""
    longest = rule.max_hold
    if isinstance(longest, Column):
        longest = int(rows.agg(F.max(longest)).first()[0] or 1)
    if horizon is not None and horizon < longest:
        raise ValueError(f"horizon {horizon} is shorter than max_hold {longest}")
    return max(1, longest if horizon is None else horizon)


def backtest(
    bars: DataFrame,
    rule: ExitRule,
    *,
    signal="signal",
    horizon: int | None = None,
    keys: Sequence[str] = ("symbol",),
    ts="ts",
    atr: str | None = "atr",
    keep: Sequence[str] = (),
    block_rows: int | None = None,
) -> DataFrame:
    """Accepted trades of one configuration. The path ahead is as long as the rule can hold, so
    ``end_of_data`` says that the series ended."""
    horizon = reach(rule, bars, horizon)
    laid = over_series(bars, entry_path(horizon, atr, ts), keys=keys, order=ts, block_rows=block_rows)
    trades = resolve_exits(laid.filter(F.col(signal) == 1), rule, keys=keys, ts=ts, keep=keep)
    return select_trades(trades, keys=keys, block_rows=block_rows or BLOCK)


# ------------------------------------------------------------------------------------ sweep


def parameter_grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """All combinations with a ``config_id``; a few thousand rows made on the driver."""
    names = list(values)
    combos = [(i, *v) for i, v in enumerate(product(*values.values()))]
    return spark.createDataFrame(combos, ["config_id", *names])


def named_grid(spark: SparkSession, rows: Mapping[str, Mapping]) -> DataFrame:
    """Scenario table: one named configuration per entry."""
    data = [{"config_id": i, "scenario": n, **dict(r)} for i, (n, r) in enumerate(rows.items())]
    return spark.createDataFrame(pd.DataFrame(data))


# Grids are made on the driver and broadcast; larger ones are refused.
GRID_LIMIT = 100_000


def sweep_trades(
    bars: DataFrame,
    grid: DataFrame,
    rule: ExitRule,
    entry: Column,
    *,
    horizon: int | None = None,
    keys: Sequence[str] = ("symbol",),
    ts="ts",
    atr: str | None = "atr",
    candidate: Column | None = None,
    entry_params: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Accepted trades of every configuration.

    Bars are laid out once. ``candidate`` is a condition every configuration implies; only rows
    passing it meet the grid, where ``entry`` decides per configuration. ``rule`` and ``entry``
    may use grid columns. Columns named in ``entry_params`` are used by ``entry`` alone:
    configurations that differ in nothing else share one resolved exit. ``columns`` are the trade
    columns to carry on (all, if not given); row numbers are always kept.
    """
    horizon = reach(rule, grid, horizon)
    laid = over_series(bars, entry_path(horizon, atr, ts), keys=keys, order=ts)
    if candidate is not None:
        laid = laid.filter(candidate)
    if grid.limit(GRID_LIMIT + 1).count() > GRID_LIMIT:
        raise ValueError(f"a grid has at most {GRID_LIMIT} rows: sweep it in parts")
    # One row per distinct exit configuration, with the configurations that share it.
    alike = [c for c in grid.columns if c not in ("config_id", "scenario", *entry_params)]
    shared = grid.groupBy(*alike).agg(
        F.collect_list(F.struct("config_id", *entry_params)).alias("_configs")
    )
    bar = [c for c in laid.columns if c not in ("_path", "_entry_rn")]
    both = laid.withColumn("_bar", F.struct(*bar)).crossJoin(F.broadcast(shared))
    exits = F.struct(*alike).alias("_exit") if alike else F.struct(F.lit(0)).alias("_exit")
    trades = resolve_exits(
        both.withColumn("_exit", exits), rule, keys=keys, ts=ts, keep=["_bar", "_exit", "_configs"]
    )
    names = [c for c in trades.columns if c not in ("_bar", "_exit", "_configs")]
    if columns is not None:
        names = [c for c in names if c in (*keys, *columns, "entry_rn", "exit_rn")]
    rows = trades.select(
        "_bar.*",
        *(["_exit.*"] if alike else []),
        F.struct(*names).alias("_t"),
        F.explode("_configs").alias("_c"),
    ).select("*", "_c.*")
    accepted = rows.filter(entry).select("config_id", "_t.*")
    return select_trades(accepted, keys=["config_id", *keys])


# What trade metrics read of a trade.
METRIC_COLUMNS = ("pnl_pct", "pnl_r", "win", "candles_held")


def sweep(bars, grid, rule, entry, *, min_trades: int = 0, no_loss=float("inf"), **kw) -> DataFrame:
    """One metrics row per configuration with at least ``min_trades`` trades."""
    trades = sweep_trades(bars, grid, rule, entry, columns=METRIC_COLUMNS, **kw)
    m = trade_metrics(trades, ["config_id"], no_loss=no_loss)
    m = m.filter(F.col("total_trades") >= min_trades)
    return null_safe_join(grid, m, ["config_id"], "inner")
