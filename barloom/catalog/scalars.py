"""Per-row feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, bars, bars_sql, query, ticks
from barloom.functions import scalars as sc

# Stand-ins for indicator columns, so that bin and flag features can be checked on their own.
IND_CTE = f"""{bars_sql()}, ind AS (SELECT *, 60 * (high - low) / high AS adx,
  CASE WHEN high > low THEN 100 * (close - low) / (high - low) ELSE 0 END AS rsi,
  volume / 3 AS volume_ratio, (close - open) / open * 2 AS dist_pct,
  abs(close - open) / open * 100 AS body, floor((hour(ts) * 60 + minute(ts)) / 15) AS slot,
  (high - low) / close AS volatility, close - open AS macd_hist FROM bars)"""
IND = "WITH " + IND_CTE


def indicators(spark, sf):
    b = bars(spark, sf)
    return b.withColumns(
        {
            "adx": (F.col("high") - F.col("low")) * 60 / F.col("high"),
            "rsi": F.when(
                F.col("high") > F.col("low"),
                (F.col("close") - F.col("low")) * 100 / (F.col("high") - F.col("low")),
            ).otherwise(0.0),
            "volume_ratio": F.col("volume") / 3,
            "dist_pct": (F.col("close") - F.col("open")) / F.col("open") * 2,
            "body": sc.body_pct(),
            "slot": sc.time_slot(),
            "volatility": sc.span() / F.col("close"),
            "macd_hist": F.col("close") - F.col("open"),
        }
    )


def case(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def simple(name, cols, make, exprs, source=bars, cte=BARS, table="bars"):
    """Register a projection: ``make()`` gives Columns, ``exprs`` their SQL."""
    spec = "symbol ts " + cols
    body = ", ".join(f'{e} AS "{n}"' for n, e in exprs.items())
    query(name, spec, f"{cte} SELECT symbol, ts, {body} FROM {table}")(
        lambda spark, sf: source(spark, sf).withColumns(make())
    )


simple(
    "p1_candle_body",
    "body:d body_c:d",
    lambda: {"body": sc.body_pct(), "body_c": sc.body_pct("close") / 100},
    {"body": "abs(close - open) / open * 100", "body_c": "abs(close - open) / close"},
)
simple(
    "p2_candle_range",
    "r:d r_open:d r_close:d r_low:d",
    lambda: {
        "r": sc.span(),
        "r_open": sc.range_pct(),
        "r_close": sc.range_pct("close"),
        "r_low": sc.range_pct("low"),
    },
    {
        "r": "high - low",
        "r_open": "(high - low) / nullif(open, 0) * 100",
        "r_close": "(high - low) / nullif(close, 0) * 100",
        "r_low": "(high - low) / nullif(low, 0) * 100",
    },
)
simple(
    "p3_shadows",
    "up:d down:d up_pct:d down_pct:d",
    lambda: {
        "up": sc.upper_shadow(),
        "down": sc.lower_shadow(),
        "up_pct": sc.div(sc.upper_shadow(), F.col("open")) * 100,
        "down_pct": sc.div(sc.lower_shadow(), F.col("close")),
    },
    {
        "up": "high - greatest(open, close)",
        "down": "least(open, close) - low",
        "up_pct": "(high - greatest(open, close)) / open * 100",
        "down_pct": "(least(open, close) - low) / close",
    },
)
simple(
    "p4_body_to_range",
    "ratio:d eff:d",
    lambda: {
        "ratio": sc.body_to_range(),
        "eff": sc.efficiency_eps(sc.body_pct(), sc.range_pct("low")),
    },
    {
        "ratio": "CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END",
        "eff": "(abs(close - open) / nullif(open, 0) * 100) / ((high - low) / nullif(low, 0) * 100 + 1e-10)",
    },
)
simple(
    "p5_wick_to_body",
    "wick:d2",
    lambda: {"wick": F.when(sc.body() > 0, sc.wick_to_body())},
    {
        "wick": "CASE WHEN close <> open THEN ((high - low) / close - abs(close - open) / close)"
        " / (abs(close - open) / close + 1e-10) END"
    },
)
simple(
    "p6_candle_flags",
    "green:i red:i doji:i doji_open:i doji_range:i",
    lambda: {
        "green": sc.green(),
        "red": sc.red(),
        "doji": sc.doji(),
        "doji_open": sc.doji("open"),
        "doji_range": sc.doji("range"),
    },
    {
        "green": case("close > open"),
        "red": case("close < open"),
        "doji": case("close = open"),
        "doji_open": case("abs(close - open) < open * 0.0001"),
        "doji_range": case("abs(close - open) < (high - low) / close * 0.1"),
    },
)
simple(
    "p7_hammer_star",
    "hammer:i star:i",
    lambda: {"hammer": sc.hammer(), "star": sc.shooting_star()},
    {
        "hammer": case("(least(open, close) - low) / close > abs(close - open) / close * 2 AND close > open"),
        "star": case("(high - greatest(open, close)) / close > abs(close - open) / close * 2 AND close < open"),
    },
)
simple(
    "p8_small_candle",
    "s20:i s50:i s200:i",
    lambda: {"s20": sc.small_candle(), "s50": sc.small_candle(50), "s200": sc.small_candle(200)},
    {
        "s20": case("abs(close - open) / open * 100 <= 0.2"),
        "s50": case("abs(close - open) / open * 100 <= 50"),
        "s200": case("abs(close - open) / open * 100 <= 200"),
    },
)


def _bins_sql(v, edges, names, sides):
    sides = [sides] * len(edges) if isinstance(sides, str) else sides
    out = {}
    for i, n in enumerate(names):
        conds = []
        if i > 0:
            conds.append(f"{v} {'>=' if sides[i - 1] == 'left' else '>'} {edges[i - 1]}")
        if i < len(edges):
            conds.append(f"{v} {'<' if sides[i] == 'left' else '<='} {edges[i]}")
        out[n] = case(" AND ".join(conds))
    return out


def _bins(name, tables, value, sql_value):
    cols, exprs = [], {}
    for tag, t in tables.items():
        for n, e in _bins_sql(sql_value, *t).items():
            cols.append(f"{tag}_{n}:i")
            exprs[f"{tag}_{n}"] = e

    def make():
        return {
            f"{tag}_{n}": e for tag, t in tables.items() for n, e in sc.bucketize(value(), *t).items()
        }

    simple(name, " ".join(cols), make, exprs, indicators, IND, "ind")


_bins(
    "p9_candle_size",
    {"a": sc.CANDLE_BINS, "b": sc.CANDLE_BINS_FINE},
    lambda: F.col("body") / 100,
    "body / 100",
)
_bins("p10_adx_level", {"a": sc.ADX_BINS, "b": sc.ADX_BINS_HIGH}, lambda: F.col("adx"), "adx")
_bins(
    "p11_volume_level",
    {"a": sc.VOLUME_BINS, "b": sc.VOLUME_BINS_LEFT, "c": sc.VOLUME_BINS_BALANCED},
    lambda: F.col("volume_ratio"),
    "volume_ratio",
)
simple(
    "p11_volume_extremes",
    "volume_spike:i volume_dry:i",
    lambda: sc.volume_extremes(),
    {"volume_spike": case("volume_ratio > 1.5"), "volume_dry": case("volume_ratio < 0.7")},
    indicators,
    IND,
    "ind",
)

# Time features run on the ticks themselves, which carry minutes.
TICKS = "WITH t AS (SELECT event_type AS symbol, ts, hour(ts) AS h, minute(ts) AS m, hour(ts) * 60 + minute(ts) AS mod FROM events)"
simple(
    "p12_time_parts",
    "hour:i minute:i time_minutes:i",
    lambda: sc.time_columns(),
    {"hour": "h", "minute": "m", "time_minutes": "mod"},
    ticks,
    TICKS,
    "t",
)
simple(
    "p13_time_slot",
    "slot:i slot1:i",
    lambda: {"slot": sc.time_slot(), "slot1": sc.time_slot(size=1)},
    {"slot": "floor(mod / 15)", "slot1": "mod"},
    ticks,
    TICKS,
    "t",
)
simple(
    "p14_entry_windows",
    "entry_window_1:i entry_window_2:i in_entry_window:i relaxed_1:i relaxed_2:i relaxed:i",
    lambda: {
        **sc.time_columns(),
        **dict(zip(("relaxed_1", "relaxed_2", "relaxed"), sc.relaxed_windows().values(), strict=True)),
    },
    {
        "entry_window_1": case("mod BETWEEN 555 AND 570"),
        "entry_window_2": case("mod BETWEEN 600 AND 660"),
        "in_entry_window": case("mod BETWEEN 555 AND 570 OR mod BETWEEN 600 AND 660"),
        "relaxed_1": case("h = 9 AND m >= 15"),
        "relaxed_2": case("h IN (10, 11)"),
        "relaxed": case("h IN (10, 11) OR (h = 9 AND m >= 15)"),
    },
    ticks,
    TICKS,
    "t",
)
simple(
    "p15_session_flags",
    "market_open_hour:i first_hour:i mid_session:i last_hour:i morning_session:i afternoon_session:i best_hours:i",
    lambda: {**sc.time_columns(), **sc.session_columns()},
    {
        "market_open_hour": case("h = 9"),
        "first_hour": case("mod BETWEEN 555 AND 615"),
        "mid_session": case("h BETWEEN 11 AND 13"),
        "last_hour": case("h >= 15"),
        "morning_session": case("h >= 9 AND h < 12"),
        "afternoon_session": case("h >= 12 AND h < 15"),
        "best_hours": case("h >= 10 AND h < 14"),
    },
    ticks,
    TICKS,
    "t",
)
_SLOTS = ("is_9_15_to_9_30", "is_9_30_to_10_00", "is_10_00_to_10_30", "is_10_30_to_11_00", "is_11_00_to_12_00")
simple(
    "p16_half_hour_slots",
    " ".join(f"a_{n}:i b_{n}:i" for n in _SLOTS),
    lambda: {
        **{f"a_{k}": v for k, v in sc.half_hour_slots().items()},
        **{f"b_{k}": v for k, v in sc.half_hour_slots(upper_inclusive=False).items()},
    },
    {
        **dict(
            zip(
                [f"a_{n}" for n in _SLOTS],
                map(
                    case,
                    ("h = 9 AND m BETWEEN 15 AND 30", "h = 9 AND m > 30", "h = 10 AND m <= 30",
                     "h = 10 AND m > 30", "h = 11"),
                ),
                strict=True,
            )
        ),
        **dict(
            zip(
                [f"b_{n}" for n in _SLOTS],
                map(
                    case,
                    ("h = 9 AND m < 30", "h = 9 AND m >= 30", "h = 10 AND m < 30",
                     "h = 10 AND m >= 30", "h = 11"),
                ),
                strict=True,
            )
        ),
    },
    ticks,
    TICKS,
    "t",
)
simple(
    "p17_calendar",
    "day_of_week:i minutes_since_open:i",
    lambda: sc.calendar_columns(),
    {"day_of_week": "isodow(ts) - 1", "minutes_since_open": "mod - 555"},
    ticks,
    TICKS,
    "t",
)
simple(
    "p18_range_flags",
    "rsi_overbought:i rsi_oversold:i rsi_neutral:i adx_in_range:i",
    lambda: sc.range_flags(),
    {
        "rsi_overbought": case("rsi > 70"),
        "rsi_oversold": case("rsi < 30"),
        "rsi_neutral": case("rsi >= 40 AND rsi <= 60"),
        "adx_in_range": case("adx >= 20 AND adx <= 36"),
    },
    indicators,
    IND,
    "ind",
)
simple(
    "p19_interactions",
    "trap_context:d ema_adx:d volume_candle:d time_ema:d rsi_volume_ratio:d rsi_volatility:d volume_ema:d "
    "rsi_ema_divergence:d macd_rsi:d",
    lambda: sc.interactions(
        dist="dist_pct", adx="adx", volume_ratio="volume_ratio", body="body", slot="slot",
        rsi="rsi", volatility="volatility", macd_hist="macd_hist",
    ),
    {
        "trap_context": "dist_pct * adx",
        "ema_adx": "dist_pct * adx / 100",
        "volume_candle": "volume_ratio * body",
        "time_ema": "slot * abs(dist_pct)",
        "rsi_volume_ratio": "rsi * volume_ratio",
        "rsi_volatility": "rsi * volatility",
        "volume_ema": "volume_ratio * dist_pct",
        "rsi_ema_divergence": "(rsi - 50) * dist_pct",
        "macd_rsi": "macd_hist * (rsi - 50) / 100",
    },
    indicators,
    IND,
    "ind",
)
_COMP = ("ema_adx_signal", "volume_candle_signal", "time_ema_signal")
simple(
    "p20_composites",
    " ".join(f"a_{n}:i b_{n}:i" for n in _COMP),
    lambda: {
        **{f"a_{k}": v for k, v in sc.composites("near").items()},
        **{f"b_{k}": v for k, v in sc.composites("trend").items()},
    },
    {
        "a_ema_adx_signal": case("adx >= 20 AND adx <= 36 AND abs(dist_pct) < 1"),
        "a_volume_candle_signal": case("volume_ratio > 0.8 AND body > 0.15"),
        "a_time_ema_signal": case("hour(ts) BETWEEN 9 AND 14 AND abs(dist_pct) < 2"),
        "b_ema_adx_signal": case("dist_pct > 0 AND adx > 25"),
        "b_volume_candle_signal": case("volume_ratio > 1 AND close > open"),
        "b_time_ema_signal": case("hour(ts) >= 10 AND hour(ts) < 14 AND dist_pct > 0"),
    },
    indicators,
    IND,
    "ind",
)


@query(
    "p21_combinations",
    "symbol ts rsi_macd_signal:i volume_confirmation:i ema_cross:i",
    IND
    + f"""SELECT symbol, ts, {case('rsi > 50 AND macd_hist > 0')} AS rsi_macd_signal,
  {case('volume_ratio > 1.5')} AS volume_confirmation, {case('close > open')} AS ema_cross FROM ind""",
)
def p21(spark, sf):
    d = indicators(spark, sf).withColumnsRenamed({"macd_hist": "macd", "volume_ratio": "volume_ratio_20"})
    d = d.withColumns({"obv": F.col("volume"), "ema_12": F.col("close"), "ema_26": F.col("open")})
    return d.withColumns(sc.combination_columns(d.columns))


@query(
    "p22_select_features",
    "symbol ts adx:d rsi:d",
    IND + "SELECT symbol, ts, adx, rsi FROM ind",
)
def p22(spark, sf):
    return sc.select_features(indicators(spark, sf), ["adx", "not_there", "rsi"])


simple(
    "p23_setup_quality",
    "setup_quality_score:i high_quality_setup:i",
    lambda: sc.setup_quality(
        {"fast": "close", "slow": "open", "slope": "macd_hist", "spike": "volume_ratio",
         "strong": "green", "hours": "hours", "dist": "near"}
    ),
    {
        "setup_quality_score": (
            _score := f"({case('close > open AND macd_hist > 0 OR close < open AND macd_hist < 0')}"
            f" + {case('volume_ratio > 1.2')} + {case('close > open')}"
            f" + {case('hour(ts) >= 10 AND hour(ts) < 14')} + {case('abs(dist_pct / 100) < 0.01')})"
        ),
        "high_quality_setup": case(f"{_score} >= 4"),
    },
    lambda spark, sf: indicators(spark, sf).withColumns(
        {"green": sc.green(), "hours": sc.session_columns()["best_hours"], "near": F.col("dist_pct") / 100}
    ),
    IND,
    "ind",
)
