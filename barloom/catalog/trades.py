"""Trade queries, checked against a recursive walk of every candidate's path."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, W, bars, bars_sql, query
from barloom.catalog.recursive import recur
from barloom.catalog.signals import scored
from barloom.catalog.windows import TR, rolled
from barloom.operators import recursive as re_
from barloom.operators import signals as sg
from barloom.operators import trades as tr
from barloom.operators import windows as wi
from barloom.plans.series import columns_step, over_series

COLS = (
    "symbol entry_time exit_time entry_price:d exit_price:d exit_reason pnl_pct:d pnl_points:d pnl_r:d4 "
    "candles_held:i win:i stop_loss_pct:d highest_price:d max_rr_reached:d4"
)
SIGNAL_SQL = "close > open AND volume >= 2 AND atr IS NOT NULL"


def signal_bars(spark, sf):
    d = over_series(bars(spark, sf), wi.atr_sma(14), wi.swings((10,), (10,)))
    on = (F.col("close") > F.col("open")) & (F.col("volume") >= 2) & F.col("atr").isNotNull()
    return d.withColumn("signal", F.coalesce(on, F.lit(False)).cast("int"))


def slope_step():
    """Is the 50-row average above where it was five rows before? The first five rows pass."""
    return columns_step(
        lambda f: {"slope_ok": (f.rn <= 5) | F.coalesce(F.col("ema_50") > f.lag("ema_50", 5), F.lit(False))},
        back=5 + re_.ema_back(50),
    )


def trade_ctes(
    stop, target, *, be=None, start=None, trail=None, on_high=False, hold=20, eod=915, signal=SIGNAL_SQL, trend=False, grid=None
):
    """CTEs ending in ``trades`` (all candidates) and ``accepted``. ``trend`` adds the slope of the
    50-row average and the recent range to what ``signal`` can use. ``grid`` is SQL of a table of
    parameters with a ``cfg`` number: every candidate is walked for each, under ``symbol|cfg``."""
    sym, more, w_more, meets, who = "w.symbol", "", "", "", "symbol"
    if grid is not None:
        sym, meets, who = "w.sym", f" CROSS JOIN ({grid}) g", "symbol || '|' || cfg"
        more, w_more = ", sym, p_be, p_start, p_trail", ", w.sym, w.p_be, w.p_start, w.p_trail"
    slope = ""
    if trend:
        slope = recur("e50", "n0", {"ema_50": ("close", 2.0 / 51)}) + f""",
n0t AS (SELECT n0.*, ema_50 - lag(ema_50, 5) OVER w AS slope,
  {rolled('max', 'high', 20)} AS hi20, {rolled('min', 'low', 20)} AS lo20 FROM n0 JOIN e50 USING (symbol, rn) {W}),
"""
    source = "n0t" if trend else "n0"
    gain = "(CASE WHEN e > s0 THEN (h - e) / (e - s0) ELSE 0 END)"
    be_now = f"be OR {gain} >= {be}" if be is not None else "be"
    s1 = f"CASE WHEN NOT be AND {gain} >= {be} THEN e ELSE stop END" if be is not None else "stop"
    if start is not None:
        tr_now = f"tr OR {gain} >= {start}"
    else:
        tr_now = "bc > hi" if on_high else "tr"
    s2 = (
        f"CASE WHEN tr2 AND h - ba * {trail} > s1 THEN h - ba * {trail} ELSE s1 END"
        if trail is not None
        else "s1"
    )
    late = f"WHEN bm >= {eod} THEN 'eod'" if eod is not None else ""
    return f"""WITH RECURSIVE {bars_sql()}, n0 AS (SELECT *, row_number() OVER w AS rn,
  hour(ts) * 60 + minute(ts) AS m, {TR} AS tr_, min(low) OVER (w ROWS 9 PRECEDING) AS swing_low_10
  FROM bars {W}),
{slope}n AS (SELECT *, {rolled('avg', 'tr_', 14)} AS atr FROM {source} {W}),
cand AS (SELECT {who} AS symbol, rn AS c, ts AS entry_time, close AS e, {stop} AS s0, {target} AS tgt{more.replace('sym', 'symbol AS sym')}
  FROM n{meets} WHERE {signal}),
walk AS (SELECT symbol, c, entry_time, e, s0, tgt{more}, 0 AS k, s0 AS stop, e AS hi, false AS be, false AS tr,
    CAST(NULL AS VARCHAR) AS reason, e AS price, entry_time AS hit_ts FROM cand
  UNION ALL
  SELECT symbol, c, entry_time, e, s0, tgt{more}, k, s2, h, be2, tr2, reason,
    CASE reason WHEN 'profit_target' THEN tgt WHEN 'stop_loss' THEN s2 ELSE bc END, bt
  FROM (SELECT *, CASE WHEN bh >= tgt THEN 'profit_target' WHEN bl <= s2 THEN 'stop_loss'
      WHEN k >= {hold} THEN 'max_holding' {late} END AS reason
    FROM (SELECT *, {s2} AS s2
      FROM (SELECT *, {s1} AS s1, {be_now} AS be2, {tr_now} AS tr2
        FROM (SELECT w.symbol, w.c, w.entry_time, w.e, w.s0, w.tgt{w_more}, w.k + 1 AS k, w.stop, w.hi, w.be, w.tr,
            greatest(w.hi, b.close) AS h, b.close AS bc, b.high AS bh, b.low AS bl, b.atr AS ba, b.m AS bm, b.ts AS bt
          FROM walk w JOIN n b ON b.symbol = {sym} AND b.rn = w.c + w.k + 1 WHERE w.reason IS NULL))))),
trades AS MATERIALIZED (SELECT symbol, c AS entry_rn, c + k AS exit_rn, entry_time, hit_ts AS exit_time, e AS entry_price,
    price AS exit_price, coalesce(reason, 'end_of_data') AS exit_reason,
    (price - e) / e * 100 AS pnl_pct, price - e AS pnl_points,
    CASE WHEN e > s0 THEN (price - e) / (e - s0) ELSE 0 END AS pnl_r,
    CASE WHEN reason IS NULL THEN k + 1 ELSE k END AS candles_held,
    CASE WHEN price > e THEN 1 ELSE 0 END AS win, (stop - e) / e * 100 AS stop_loss_pct, hi AS highest_price,
    CASE WHEN e > s0 THEN (hi - e) / (e - s0) ELSE 0 END AS max_rr_reached
  FROM walk QUALIFY row_number() OVER (PARTITION BY symbol, c ORDER BY k DESC) = 1),
nxt AS MATERIALIZED (SELECT a.symbol, a.entry_rn, b.entry_rn AS nx FROM trades a
  ASOF LEFT JOIN trades b ON b.symbol = a.symbol AND a.exit_rn < b.entry_rn),
pick AS (SELECT symbol, min(entry_rn) AS rn FROM trades GROUP BY 1
  UNION ALL SELECT p.symbol, x.nx FROM pick p JOIN nxt x ON x.symbol = p.symbol AND x.entry_rn = p.rn
  WHERE x.nx IS NOT NULL),
accepted AS (SELECT t.* FROM trades t JOIN pick p ON p.symbol = t.symbol AND p.rn = t.entry_rn)"""


def backtest_query(name, rule, **sql):
    query(name, COLS, trade_ctes(**sql) + " SELECT * FROM accepted")(
        lambda spark, sf: tr.backtest(signal_bars(spark, sf), rule())
    )


backtest_query(
    "t1_fixed_exit",
    lambda: tr.fixed_rule(0.5, 0.3),
    stop=f"close * {1 - 0.3!r}",
    target="close * (1 + 0.5)",
)
backtest_query(
    "t2_atr_stop_exit",
    lambda: tr.atr_rule(0.5, 0.5),
    stop="close - atr * 0.5",
    target="close * (1 + 0.5)",
)
backtest_query(
    "t3_trailing_exit",
    lambda: tr.trailing_rule(0.5, 3.0, 1.0, 1.5, 1.0, 15),
    stop="close - atr * 0.5",
    target="close + atr * 3.0",
    be=1.0,
    start=1.5,
    trail=1.0,
    hold=15,
)
backtest_query(
    "t3_tight_exit",
    lambda: tr.tight_rule(stop_atr=0.4, target_atr=2.0),
    stop="close - atr * 0.4",
    target="close + atr * 2.0",
    be=0.5,
    start=1.0,
    trail=0.5,
    hold=15,
)
backtest_query(
    "t4_ratchet_exit",
    lambda: tr.ratchet_rule(0.6, 1.5, 0.75),
    stop="close - atr * 0.6",
    target="close + atr * 1.5",
    trail=0.75,
    on_high=True,
)
backtest_query(
    "t5_swing_exit",
    lambda: tr.swing_rule(1.5),
    stop="greatest(swing_low_10 - atr * 0.2, close - atr * 3.0)",
    target="close + (close - greatest(swing_low_10 - atr * 0.2, close - atr * 3.0)) * 1.5",
)
backtest_query(
    "t6_bracket_exit",
    lambda: tr.bracket_rule(0.5, 1.0, eod_minute=None),
    stop="close - atr * 0.5",
    target="close + atr * 1.0",
    eod=None,
)


backtest_query(
    "t1_long_holding",
    lambda: tr.atr_rule(3.0, target_atr=4.0, max_hold=40, eod_minute=None),
    stop="close - atr * 3.0",
    target="close + atr * 4.0",
    hold=40,
    eod=None,
)


@query(
    "t1_candidate_exits",
    COLS,
    trade_ctes(f"close * {1 - 0.3!r}", "close * (1 + 0.5)") + " SELECT * FROM trades",
)
def t1_all(spark, sf):
    laid = over_series(signal_bars(spark, sf), tr.entry_path(20))
    return tr.resolve_exits(laid.filter("signal = 1"), tr.fixed_rule(0.5, 0.3))


@query(
    "t7_select_trades",
    "symbol entry_rn:i exit_rn:i",
    trade_ctes(f"close * {1 - 0.9!r}", "close * (1 + 9.0)", eod=None) + " SELECT * FROM accepted",
)
def t7(spark, sf):
    laid = over_series(signal_bars(spark, sf), tr.entry_path(20))
    t = tr.resolve_exits(laid.filter("signal = 1"), tr.fixed_rule(9.0, 0.9, eod_minute=None))
    return tr.select_trades(t, block_rows=256)


@query(
    "t8_end_of_data",
    "symbol entry_time exit_time exit_price:d candles_held:i exit_reason",
    trade_ctes(f"close * {1 - 0.99!r}", "close * (1 + 99.0)", eod=None)
    + " SELECT * FROM trades WHERE exit_reason = 'end_of_data'",
)
def t8(spark, sf):
    laid = over_series(signal_bars(spark, sf), tr.entry_path(20))
    t = tr.resolve_exits(laid.filter("signal = 1"), tr.fixed_rule(99.0, 0.99, eod_minute=None))
    return t.filter("exit_reason = 'end_of_data'")


METRICS = "total_trades:i winning_trades:i losing_trades:i win_rate:d total_pnl:d4 avg_pnl:d avg_win:d avg_loss:d avg_r:d"
ONE_CONFIG = """, one AS (SELECT count(*) AS total_trades, sum(win) AS winning_trades,
  count(*) - sum(win) AS losing_trades, avg(win) * 100 AS win_rate, sum(pnl_pct) AS total_pnl,
  avg(pnl_pct) AS avg_pnl, coalesce(avg(pnl_pct) FILTER (win = 1), 0) AS avg_win,
  coalesce(avg(pnl_pct) FILTER (win = 0), 0) AS avg_loss, avg(pnl_r) AS avg_r FROM accepted)"""

GRID = {"stop_atr": [0.5, 1.0], "target_atr": [1.0, 2.0], "min_volume": [2.0, 3.0]}


def _sweep_sql():
    """Union of single-configuration backtests."""
    from itertools import product

    parts = []
    for i, (s, t, v) in enumerate(product(*GRID.values())):
        ctes = trade_ctes(
            f"close - atr * {s}", f"close + atr * {t}", be=1.0, start=1.5, trail=1.0, hold=15,
            signal=f"close > open AND volume >= {v} AND atr IS NOT NULL",
        )
        parts.append(f"SELECT {i} AS config_id, * FROM ({ctes}{ONE_CONFIG} SELECT * FROM one)")
    return " UNION ALL ".join(parts)


@query("t9_parameter_sweep", "config_id:i " + METRICS, _sweep_sql())
def t9(spark, sf):
    rule = tr.trailing_rule(F.col("stop_atr"), F.col("target_atr"), 1.0, 1.5, 1.0, 15)
    entry = (F.col("signal") == 1) & (F.col("volume") >= F.col("min_volume"))
    return tr.sweep(
        signal_bars(spark, sf),
        tr.parameter_grid(spark, **GRID),
        rule,
        entry,
        candidate=F.col("signal") == 1,
        entry_params=("min_volume",),
    )


#: All 648 combinations: stops, targets, break-even, start and distance of trailing, trend filter.
FULL_GRID = {
    "stop_atr": [1.0, 1.5, 2.0],
    "target_atr": [1.5, 2.0, 2.5, 3.0],
    "breakeven_rr": [0.5, 1.0, 1.5],
    "trail_start_rr": [1.0, 1.5, 2.0],
    "trail_atr": [0.5, 1.0, 1.5],
    "trend_filter": [False, True],
}


def _full_sql():
    names = ("p_stop", "p_target", "p_be", "p_start", "p_trail", "p_trend")
    values = list(FULL_GRID.values())
    tables = ", ".join(
        f"(VALUES {', '.join(f'({i}, {v})' for i, v in enumerate(vs))}) v{k}(i{k}, {n})"
        for k, (n, vs) in enumerate(zip(names, values))
    )
    number = "0"
    for k, vs in enumerate(values):
        number = f"({number}) * {len(vs)} + i{k}"
    grid = f"SELECT {number} AS cfg, {', '.join(names)} FROM {tables}"
    ctes = trade_ctes(
        "close - atr * p_stop", "close + atr * p_target", be="p_be", start="p_start", trail="p_trail", hold=15,
        signal=SIGNAL_SQL + " AND (NOT p_trend OR rn <= 5 OR coalesce(slope > 0, false))", trend=True, grid=grid,
    )
    by_config = ONE_CONFIG.replace("SELECT count(*)", "SELECT CAST(split_part(symbol, '|', 2) AS BIGINT) AS config_id, count(*)")
    return ctes + by_config.replace("FROM accepted)", "FROM accepted GROUP BY 1)") + " SELECT * FROM one"


@query("t9_full_grid", "config_id:i " + METRICS, _full_sql())
def t9_full(spark, sf):
    """All 648 configurations in one pass over the bars."""
    rows = over_series(signal_bars(spark, sf), re_.ema("close", (50,)), slope_step())
    names = [n for n in FULL_GRID if n != "trend_filter"]
    rule = tr.trailing_rule(*[F.col(n) for n in names], max_hold=15)
    on = F.col("signal") == 1
    return tr.sweep(
        rows,
        tr.parameter_grid(spark, **FULL_GRID),
        rule,
        on & (~F.col("trend_filter") | F.col("slope_ok")),
        candidate=on,
        entry_params=("trend_filter",),
    )


SCENARIOS = {
    "base": {"stop_atr": 1.0, "target_atr": 1.5, "max_hold": 20},
    "wide": {"stop_atr": 2.0, "target_atr": 3.0, "max_hold": 20},
    "quick": {"stop_atr": 0.5, "target_atr": 1.0, "max_hold": 5},
    "patient": {"stop_atr": 3.0, "target_atr": 4.0, "max_hold": 25},
}


@query(
    "t10_scenario_table",
    "scenario " + METRICS,
    " UNION ALL ".join(
        f"SELECT '{n}' AS scenario, * FROM ("
        + trade_ctes(
            f"close - atr * {p['stop_atr']}", f"close + atr * {p['target_atr']}", hold=p["max_hold"], eod=None
        )
        + ONE_CONFIG
        + " SELECT * FROM one)"
        for n, p in SCENARIOS.items()
    ),
)
def t10(spark, sf):
    rule = tr.atr_rule(F.col("stop_atr"), target_atr=F.col("target_atr"), max_hold=F.col("max_hold"), eod_minute=None)
    return tr.sweep(
        signal_bars(spark, sf),
        tr.named_grid(spark, SCENARIOS),
        rule,
        F.col("signal") == 1,
        candidate=F.col("signal") == 1,
    )


def _scenario(name, rr, *filters, swing=False):
    flags = {f"{f}_filter": f in filters for f in ("ema", "volume", "candle", "structure")}
    return name, {"swing": swing, "stop_atr": 2.0, "rr": rr, **flags}


ALL_FILTERS = ("ema", "volume", "candle", "structure")
#: The nine named configurations.
NAMED = dict(
    [
        _scenario("baseline", 1.5, "ema"),
        _scenario("volume", 1.5, "ema", "volume"),
        _scenario("strong candle", 1.5, "ema", "candle"),
        _scenario("structure", 1.5, "ema", "structure"),
        _scenario("all filters", 1.5, *ALL_FILTERS),
        _scenario("all filters, 1:2", 2.0, *ALL_FILTERS),
        _scenario("all filters, 1:3", 3.0, *ALL_FILTERS),
        _scenario("swing stop, 1:2, all filters", 2.0, *ALL_FILTERS, swing=True),
        _scenario("swing stop, 1:3, all filters", 3.0, *ALL_FILTERS, swing=True),
    ]
)
FILTERS_SQL = {
    "ema_filter": "(rn <= 5 OR coalesce(slope > 0, false))",
    "volume_filter": "volume / 3 >= 1.2",
    "candle_filter": "close > open AND (close - open) / open * 100 >= 0.15 AND close >= (high + low) / 2",
    "structure_filter": "(hi20 - lo20) / close * 100 >= 200",
}
BASE_SQL = (
    "CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END >= 0.4"
    " AND 60 * (high - low) / high >= 10 AND m BETWEEN 600 AND 840 AND atr IS NOT NULL"
)


def _named_sql():
    parts = []
    for name, p in NAMED.items():
        stop = "greatest(swing_low_10 - atr * 0.2, close - atr * 3.0)" if p["swing"] else f"close - atr * {p['stop_atr']}"
        signal = " AND ".join([BASE_SQL, *[sql for f, sql in FILTERS_SQL.items() if p[f]]])
        ctes = trade_ctes(stop, f"close + (close - ({stop})) * {p['rr']}", signal=signal, trend=True)
        parts.append(f"SELECT '{name}' AS scenario, * FROM ({ctes}{ONE_CONFIG} SELECT * FROM one WHERE total_trades > 0)")
    return " UNION ALL ".join(parts)


@query("t10_named_scenarios", "scenario " + METRICS, _named_sql())
def t10_named(spark, sf):
    """All nine configurations: filters are grid columns that the entry reads, stops differ by kind."""
    steps = (wi.atr_sma(14), wi.swings((10,), (10,)), wi.recent_range(), re_.ema("close", (50,)), slope_step())
    rows = over_series(scored(spark, sf), *steps)
    known = {"known": F.col("atr").isNotNull()}
    base = sg.all_of({**sg.entry_conditions(min_prob=0.4, min_adx=10, window=(600, 840)), **known})
    kinds = {
        "ema_filter": F.col("slope_ok"),
        "volume_filter": sg.all_of(sg.entry_conditions(min_volume=1.2)),
        "candle_filter": sg.all_of(sg.entry_conditions(strong_green=True)),
        "structure_filter": sg.all_of(sg.entry_conditions(min_range=200)),
    }
    entry = base
    for name, holds in kinds.items():
        entry = entry & (~F.col(name) | holds)
    stop = F.when(F.col("swing"), tr.swing_stop()).otherwise(F.col("close") - F.col("atr") * F.col("stop_atr"))
    rule = tr.ExitRule(stop=stop, target=F.col("close") + (F.col("close") - stop) * F.col("rr"))
    return tr.sweep(rows, tr.named_grid(spark, NAMED), rule, entry, candidate=base, entry_params=tuple(kinds))
