"""Window feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, W, bars, query
from barloom.operators import windows as wi
from barloom.plans.series import columns_step, over_series


def case(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def rolled(agg: str, col: str, n: int) -> str:
    f = f"OVER (w ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({col}) {f} = {n} THEN {agg}({col}) {f} END"


def lag(col: str, n: int = 1) -> str:
    return f"lag({col}, {n}) OVER w"


def pct(col: str, n: int = 1) -> str:
    return f"({col} / {lag(col, n)} - 1)"


def chain_sql(*stages: dict[str, str], base: str = "bars") -> str:
    """CTE chain: each stage adds columns computed from the stage before."""
    out, prev = [], base
    for i, st in enumerate(stages):
        body = ", ".join(f"{e} AS {n}" for n, e in st.items())
        out.append(f"g{i} AS (SELECT *, {body} FROM {prev} {W})")
        prev = f"g{i}"
    return ", " + ", ".join(out) + f" SELECT * FROM {prev}"


def feature(name: str, cols: str, steps, *stages: dict[str, str]):
    query(name, "symbol ts " + cols, BARS + chain_sql(*stages))(
        lambda spark, sf: over_series(bars(spark, sf), *steps())
    )


feature(
    "w1_sma",
    "sma_5:d sma_20:d sma_50:d volume_sma_20:d",
    lambda: [wi.sma("close", (5, 20, 50)), wi.sma("volume", (20,), "volume_sma")],
    {
        **{f"sma_{n}": rolled("avg", "close", n) for n in (5, 20, 50)},
        "volume_sma_20": rolled("avg", "volume", 20),
    },
)
feature(
    "w2_price_ratios",
    "price_sma_10_ratio:d price_sma_30_ratio:d",
    lambda: [wi.sma("close", (10, 30)), wi.price_ratios("sma_10", "sma_30")],
    {f"sma_{n}": rolled("avg", "close", n) for n in (10, 30)},
    {f"price_sma_{n}_ratio": f"close / sma_{n}" for n in (10, 30)},
)
feature(
    "w3_rate_of_change",
    "roc_10:d volume_roc_5:d",
    lambda: [wi.changes("close", (10,), "roc", 100), wi.changes("volume", (5,), "volume_roc", 100)],
    {"roc_10": pct("close", 10) + " * 100", "volume_roc_5": pct("volume", 5) + " * 100"},
)
feature(
    "w4_changes",
    "chg_1:d chg_2:d chg_3:d chg_5:d diff_3:d close_lag_2:d",
    lambda: [
        wi.changes("close", (1, 2, 3, 5), "chg"),
        wi.differences("close", (3,)),
        wi.lags(("close",), (2,)),
    ],
    {
        **{f"chg_{n}": pct("close", n) for n in (1, 2, 3, 5)},
        "diff_3": f"close - {lag('close', 3)}",
        "close_lag_2": lag("close", 2),
    },
)
feature(
    "w5_volatility",
    "returns:d volatility_5:d volatility_20:d volatility_ratio:d",
    lambda: [wi.volatility((5, 20)), wi.volatility_ratio(20, back=21)],
    {"returns": pct("close")},
    {f"volatility_{n}": rolled("stddev_samp", "returns", n) for n in (5, 20)},
    {"volatility_ratio": f"volatility_20 / ({rolled('avg', 'volatility_20', 40)})"},
)
BB = (
    {"bb_middle": rolled("avg", "close", 20), "sd": rolled("stddev_samp", "close", 20)},
    {"bb_upper": "bb_middle + sd * 2", "bb_lower": "bb_middle - sd * 2"},
    {
        "bb_width": "(bb_upper - bb_lower) / bb_middle",
        "bb_position": "(close - bb_lower) / (bb_upper - bb_lower)",
        "bb_upper_touch": case("high >= bb_upper"),
        "bb_lower_touch": case("low <= bb_lower"),
    },
)
feature(
    "w6_bollinger",
    "bb_middle:d bb_upper:d bb_lower:d bb_width:d bb_position:d",
    lambda: [wi.bollinger()],
    *BB,
)
feature(
    "w7_bollinger_touches",
    "bb_upper_touch:i bb_lower_touch:i",
    lambda: [wi.bollinger(), wi.bollinger_touches()],
    *BB,
)
MM = {"lo": rolled("min", "low", 14), "hi": rolled("max", "high", 14)}
feature(
    "w8_stochastic",
    "stoch_k:d stoch_d:d",
    lambda: [wi.stochastic()],
    MM,
    {"stoch_k": "100 * (close - lo) / (hi - lo)"},
    {"stoch_d": rolled("avg", "stoch_k", 3)},
)
feature(
    "w9_stochastic_slow",
    "stoch_k:d stoch_d:d",
    lambda: [wi.stochastic(smooth_k=3)],
    MM,
    {"raw_k": "100 * (close - lo) / (hi - lo)"},
    {"stoch_k": rolled("avg", "raw_k", 3)},
    {"stoch_d": rolled("avg", "stoch_k", 3)},
)
feature(
    "w10_williams_r",
    "williams_r:d",
    lambda: [wi.williams_r()],
    MM,
    {"williams_r": "-100 * (hi - close) / (hi - lo)"},
)
TR = (
    f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {lag('close')}), "
    f"abs(low - {lag('close')})) END"
)
feature(
    "w11_atr_sma",
    "true_range:d atr:d",
    lambda: [wi.atr_sma()],
    {"true_range": TR},
    {"atr": rolled("avg", "true_range", 14)},
)
feature(
    "w12_rsi_sma",
    "rsi:d",
    lambda: [wi.rsi_sma()],
    {"d": f"close - {lag('close')}"},
    {"g": "CASE WHEN d > 0 THEN d ELSE 0 END", "l": "CASE WHEN d < 0 THEN -d ELSE 0 END"},
    {"ag": rolled("avg", "g", 14), "al": rolled("avg", "l", 14)},
    {"rsi": "CASE WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100.0 END ELSE 100 - 100 / (1 + ag / al) END"},
)
CROSS = (
    {"sma_5": rolled("avg", "close", 5), "sma_20": rolled("avg", "close", 20)},
    {
        "cross_above": case(f"{lag('sma_5')} <= {lag('sma_20')} AND sma_5 > sma_20"),
        "cross_below": case(f"{lag('sma_5')} >= {lag('sma_20')} AND sma_5 < sma_20"),
    },
)


def cross_steps():
    return [wi.sma("close", (5, 20)), wi.cross_flags("sma_5", "sma_20", back=19)]


feature(
    "w13_event_counts",
    "cross_above_last_2:d cross_above_last_10:d cross_below_last_5:d cross_below_last_20:d",
    lambda: [
        *cross_steps(),
        wi.event_counts(("cross_above", "cross_below"), (2, 5, 10, 20), back=20),
    ],
    *CROSS,
    {
        f"cross_{d}_last_{n}": rolled("sum", f"cross_{d}", n)
        for d in ("above", "below")
        for n in (2, 5, 10, 20)
    },
)
feature(
    "w14_swings",
    "swing_high_5:d swing_low_5:d swing_high_20:d swing_low_20:d to_swing_high_10:d to_swing_low_10:d",
    lambda: [wi.swings()],
    {
        **{f"swing_high_{n}": rolled("max", "high", n) for n in (5, 10, 20)},
        **{f"swing_low_{n}": rolled("min", "low", n) for n in (5, 10, 20)},
    },
    {
        "to_swing_high_10": "(swing_high_10 - close) / close",
        "to_swing_low_10": "(close - swing_low_10) / close",
    },
)
feature(
    "w15_near_extremes",
    "near_high:i near_low:i",
    lambda: [wi.near_extremes(5, 0.3)],
    {"hi": rolled("max", "high", 5), "lo": rolled("min", "low", 5)},
    {"near_high": case("close >= hi * 0.7"), "near_low": case("close <= lo * 1.3")},
)
feature(
    "w16_recent_range",
    "range_20_pct:d",
    lambda: [wi.recent_range()],
    {"range_20_pct": f"(({rolled('max', 'high', 20)}) - ({rolled('min', 'low', 20)})) / close * 100"},
)
feature(
    "w17_strong_candle",
    "strong_candle_10:i strong_candle_20:i strong_candle_50:i",
    lambda: [wi.strong_candle((10, 20, 50))],
    {"b": "abs(close - open) / close"},
    {f"strong_candle_{n}": case(f"b > ({rolled('avg', 'b', n)})") for n in (10, 20, 50)},
)
feature(
    "w18_volume_features",
    "volume_ma20:d volume_ma50:d volume_ratio:d volume_spike:d volume_trend:d volume_roc:d",
    lambda: [wi.volume_features()],
    {f"volume_ma{n}": rolled("avg", "volume", n) for n in (20, 50)},
    {
        "volume_ratio": "volume / volume_ma20",
        "volume_spike": "volume / (volume_ma20 + 1e-10)",
        "volume_trend": "volume_ma20 / (volume_ma50 + 1e-10)",
        "volume_roc": pct("volume"),
    },
)
feature(
    "w19_rolling_corr",
    "volume_price_corr:d",
    lambda: [wi.rolling_corr()],
    {
        "volume_price_corr": "CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN "
        "corr(volume, close) OVER (w ROWS 19 PRECEDING) END"
    },
)
feature(
    "w20_lag_features",
    "ret_lag_1:d ret_lag_3:d ret_lag_5:d close_lag_2:d",
    lambda: [
        columns_step(lambda f: {"ret": wi.pct_change(f, "close")}, back=1),
        wi.lags(("ret", "close"), (1, 2, 3, 5), back=1),
    ],
    {"ret": pct("close")},
    {
        **{f"ret_lag_{n}": lag("ret", n) for n in (1, 3, 5)},
        "close_lag_2": lag("close", 2),
    },
)
feature(
    "w21_slopes",
    "sma_5_slope_3:d sma_5_slope_5:d sma_5_acceleration:d",
    lambda: [
        wi.sma("close", (5,)),
        wi.slopes(("sma_5",), back=4),
        wi.acceleration(("sma_5",), back=4),
    ],
    {"sma_5": rolled("avg", "close", 5)},
    {f"sma_5_slope_{n}": f"(sma_5 - {lag('sma_5', n)}) / {lag('sma_5', n)}" for n in (3, 5)},
    {"sma_5_acceleration": f"sma_5_slope_3 - {lag('sma_5_slope_3')}"},
)
feature(
    "w22_momentum_means",
    "momentum:d level_trend:d change_trend:d",
    lambda: [
        wi.changes("close", (1,), "chg", 100),
        wi.differences("close", (1,)),
        wi.momentum_mean("chg_1", 3, "momentum", back=1),
        wi.momentum_mean("close", 3, "level_trend"),
        wi.momentum_mean("diff_1", 3, "change_trend", back=1),
    ],
    {"chg": pct("close") + " * 100", "d": f"close - {lag('close')}"},
    {
        "momentum": rolled("avg", "chg", 3),
        "level_trend": rolled("avg", "close", 3),
        "change_trend": rolled("avg", "d", 3),
    },
)
feature(
    "w23_price_cross",
    "cross_above:i cross_below:i",
    lambda: [wi.sma("close", (20,)), wi.cross_flags("close", "sma_20", back=19)],
    {"sma_20": rolled("avg", "close", 20)},
    {
        "cross_above": case(f"{lag('close')} <= {lag('sma_20')} AND close > sma_20"),
        "cross_below": case(f"{lag('close')} >= {lag('sma_20')} AND close < sma_20"),
    },
)
feature(
    "w24_spread",
    "ema_spread:d ema_spread_roc:d fast_above:i cross_above:i cross_below:i",
    lambda: [*cross_steps(), wi.spread_features("sma_5", "sma_20", back=19)],
    *CROSS,
    {"ema_spread": "(sma_5 - sma_20) / close", "fast_above": case("sma_5 > sma_20")},
    {"ema_spread_roc": f"ema_spread - {lag('ema_spread')}"},
)
TRAP = {
    "bearish_trap": case("cross_below = 1 AND max(cross_above) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) = 1"),
    "bullish_trap": case("cross_above = 1 AND max(cross_below) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) = 1"),
}
feature(
    "w25_trap_setup",
    "bearish_trap_setup:i bullish_trap_setup:i",
    lambda: [*cross_steps(), wi.trap_flags(back=20)],
    *CROSS,
    {"bearish_trap_setup": "cross_above", "bullish_trap_setup": "cross_below"},
)
feature(
    "w26_trap_confirmed",
    "bearish_trap:i bullish_trap:i",
    lambda: [*cross_steps(), wi.trap_flags(back=20)],
    *CROSS,
    TRAP,
)
feature(
    "w26_trap_confirmed_short",
    "bearish_trap:i bullish_trap:i",
    lambda: [*cross_steps(), wi.trap_flags(back=20, lookback=3)],
    *CROSS,
    {k: v.replace("10 PRECEDING", "3 PRECEDING") for k, v in TRAP.items()},
)
feature(
    "w26_trap_confirmed_exact",
    "bearish_trap:i bullish_trap:i",
    lambda: [*cross_steps(), wi.trap_flags(back=20, lookback=1, exact=True)],
    *CROSS,
    {k: v.replace("10 PRECEDING", "1 PRECEDING") for k, v in TRAP.items()},
)
POSITION = {
    "price_position": "CASE WHEN close < sma_5 AND close < sma_20 THEN 0 WHEN close > sma_5 AND close > sma_20 THEN 2 ELSE 1 END",
    "price_distance_sma_5": "(close - sma_5) / close",
    "price_distance_sma_20": "(close - sma_20) / close",
    "near_sma_5": case("abs((close - sma_5) / close) < 0.1"),
    "near_sma_20": case("abs((close - sma_20) / close) < 0.1"),
}
feature(
    "w27_price_position",
    "price_position:i price_distance_sma_5:d9 price_distance_sma_20:d9 near_sma_5:i near_sma_20:i",
    lambda: [wi.sma("close", (5, 20)), wi.price_position("sma_5", "sma_20", 0.1)],
    CROSS[0],
    POSITION,
)
feature(
    "w28_crossover_signals",
    "bullish_cross_signal:i bearish_cross_signal:i bullish_retest_signal:i bearish_retest_signal:i",
    lambda: [
        *cross_steps(),
        wi.slopes(("sma_20",), (5,), back=19),
        wi.volume_features(),
        wi.strong_candle((20,)),
        wi.price_position("sma_5", "sma_20", 0.1),
        wi.crossover_signals("sma_20"),
    ],
    *CROSS,
    {
        "b": "abs(close - open) / close",
        "slope": f"(sma_20 - {lag('sma_20', 5)}) / {lag('sma_20', 5)}",
        "spike": f"volume / (({rolled('avg', 'volume', 20)}) + 1e-10)",
        **POSITION,
    },
    {"strong": case(f"b > ({rolled('avg', 'b', 20)})")},
    {
        "bullish_cross_signal": case("cross_above = 1 AND slope > 0 AND spike > 1.1"),
        "bearish_cross_signal": case("cross_below = 1 AND slope < 0 AND spike > 1.1"),
        "bullish_retest_signal": case("price_position = 0 AND near_sma_20 = 1 AND close > open AND strong = 1"),
        "bearish_retest_signal": case("price_position = 2 AND near_sma_20 = 1 AND close < open AND strong = 1"),
    },
)
feature(
    "w29_confirmed_signal",
    "signal:i confirmed:i",
    lambda: [
        columns_step(lambda f: {"signal": wi.flag(F.col("close") > F.col("open"))}),
        wi.confirmed_signal(),
    ],
    {"signal": case("close > open"), "rn": "row_number() OVER w"},
    {"confirmed": case(f"signal = 1 AND (rn = 1 OR {lag('signal')} = 1)")},
)
feature(
    "w30_slope_filter",
    "slope_ok",
    lambda: [wi.sma("close", (8,)), wi.slope_filter("sma_8", 5, back=7)],
    {"sma_8": rolled("avg", "close", 8), "rn": "row_number() OVER w"},
    {"slope_ok": f"rn <= 5 OR coalesce(sma_8 > {lag('sma_8', 5)}, false)"},
)


@query(
    "w31_obv",
    "symbol ts obv:d obv_sma:d obv_trend:i",
    BARS
    + chain_sql(
        {"sv": f"coalesce(sign(close - {lag('close')}), 1) * volume"},
        {"obv": "sum(sv) OVER (w ROWS UNBOUNDED PRECEDING)"},
        {"obv_sma": rolled("avg", "obv", 20)},
        {"obv_trend": case("obv > obv_sma")},
    ),
)
def w31(spark, sf):
    return over_series(wi.on_balance_volume(bars(spark, sf)), wi.obv_trend())


@query(
    "w32_pvt",
    "symbol ts pvt:d4",
    BARS
    + chain_sql(
        {"pv": f"{pct('close')} * volume"}, {"pvt": "sum(pv) OVER (w ROWS UNBOUNDED PRECEDING)"}
    ),
)
def w32(spark, sf):
    return wi.price_volume_trend(bars(spark, sf))


PNL = f", x AS (SELECT *, (close - open) / open AS pnl_pct FROM bars) "


@query(
    "w33_cumulative_pnl",
    "symbol ts cum_pnl:d4 peak:d4 drawdown:d4",
    BARS
    + PNL.rstrip()
    + chain_sql(
        {"cum_pnl": "sum(pnl_pct) OVER (w ROWS UNBOUNDED PRECEDING)"},
        {"peak": "max(cum_pnl) OVER (w ROWS UNBOUNDED PRECEDING)"},
        {"drawdown": "cum_pnl - peak"},
        base="x",
    ),
)
def w33(spark, sf):
    b = bars(spark, sf).withColumn("pnl_pct", (F.col("close") - F.col("open")) / F.col("open"))
    return wi.cumulative_pnl(b, order="ts")


@query(
    "w33_max_drawdown",
    "symbol max_drawdown:d4",
    BARS
    + PNL
    + f""", c AS (SELECT symbol, ts, sum(pnl_pct) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM x {W}),
d AS (SELECT symbol, cum - max(cum) OVER (w ROWS UNBOUNDED PRECEDING) AS dd FROM c {W})
SELECT symbol, min(dd) AS max_drawdown FROM d GROUP BY 1""",
)
def w33b(spark, sf):
    b = bars(spark, sf).withColumn("pnl_pct", (F.col("close") - F.col("open")) / F.col("open"))
    return wi.max_drawdown(b, order="ts")
