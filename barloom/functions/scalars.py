"""Per-row features as Column expressions; nothing here shuffles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-10


def flag(cond: Column) -> Column:
    """0/1; an unknown comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def div(a, b) -> Column:
    return F.try_divide(a, b)


def c(name) -> Column:
    return F.col(name) if isinstance(name, str) else name


def correlation(a, b, over=None) -> Column:
    """Pearson correlation as an aggregate or over a window; null where a side is constant."""
    a, b = c(a), c(b)
    both = a.isNotNull() & b.isNotNull()
    parts = [F.covar_pop(a, b), F.stddev_pop(F.when(both, a)), F.stddev_pop(F.when(both, b))]
    if over is not None:
        parts = [p.over(over) for p in parts]
    return F.try_divide(parts[0], parts[1] * parts[2])


# --------------------------------------------------------------------------------- candles


def body() -> Column:
    return F.abs(F.col("close") - F.col("open"))


def span() -> Column:
    return F.col("high") - F.col("low")


def body_pct(base: str = "open") -> Column:
    """Body in percent of a price; null where that is 0."""
    return div(body(), F.col(base)) * 100


def range_pct(base: str = "open") -> Column:
    """Range in percent of a price; null where that is 0."""
    return div(span(), F.col(base)) * 100


def upper_shadow() -> Column:
    return F.col("high") - F.greatest("open", "close")


def lower_shadow() -> Column:
    return F.least("open", "close") - F.col("low")


def body_to_range() -> Column:
    """Share of the range taken by the body; 0 for a flat bar."""
    return F.when(span() > 0, body() / span()).otherwise(0.0)


def efficiency_eps(body_c: Column, range_c: Column) -> Column:
    """Share of a relative range taken by the body; null where either is unknown."""
    return body_c / (range_c + EPS)


def wick_to_body(base: str = "close") -> Column:
    b, r = div(body(), F.col(base)), div(span(), F.col(base))
    return (r - b) / (b + EPS)


def green() -> Column:
    return flag(F.col("close") > F.col("open"))


def red() -> Column:
    return flag(F.col("close") < F.col("open"))


def doji(mode: str = "exact") -> Column:
    """``exact`` equality, within 0.0001 of the open, or within a tenth of the relative range."""
    if mode == "exact":
        return flag(F.col("close") == F.col("open"))
    if mode == "open":
        return flag(body() < F.col("open") * 0.0001)
    return flag(body() < div(span(), F.col("close")) * 0.1)


def hammer() -> Column:
    return flag((lower_shadow() / F.col("close") > body() / F.col("close") * 2) & (green() == 1))


def shooting_star() -> Column:
    return flag((upper_shadow() / F.col("close") > body() / F.col("close") * 2) & (red() == 1))


def small_candle(limit: float = 0.20) -> Column:
    return flag(body_pct() <= limit)


def candle_columns() -> dict[str, Column]:
    """The default candle feature group."""
    return {
        "candle_body_pct": body_pct(),
        "small_candle": small_candle(),
        "green_candle": green(),
        "red_candle": red(),
        "doji_candle": doji(),
        "candle_range": span(),
        "candle_range_pct": range_pct(),
        "upper_shadow": upper_shadow(),
        "lower_shadow": lower_shadow(),
        "upper_shadow_pct": div(upper_shadow(), F.col("open")) * 100,
        "lower_shadow_pct": div(lower_shadow(), F.col("open")) * 100,
        "body_to_range": body_to_range(),
    }


# --------------------------------------------------------------------------------- buckets


def bucketize(
    value, edges: Sequence[float], names: Sequence[str], closed: str | Sequence[str] = "left"
) -> dict[str, Column]:
    """One 0/1 column per interval between edges.

    ``closed`` says, for every edge or for each one, which side an equal value falls to:
    ``left`` puts it in the upper interval ([a, b)), ``right`` in the lower one ((a, b]).
    """
    v = c(value)
    sides = [closed] * len(edges) if isinstance(closed, str) else list(closed)

    def below(i):
        return (v < edges[i]) if sides[i] == "left" else (v <= edges[i])

    out = {}
    for i, name in enumerate(names):
        cond = F.lit(True)
        if i > 0:
            cond = cond & ~below(i - 1)
        if i < len(edges):
            cond = cond & below(i)
        out[name] = flag(cond & v.isNotNull())
    return out


# Bin tables (edges, names, which interval takes an equal value).
CANDLE_BINS = (
    (0.10, 0.15, 0.25, 0.50),
    ("micro_candle", "tiny_candle", "small_candle", "medium_candle", "large_candle"),
    "right",
)
CANDLE_BINS_FINE = (
    (0.05, 0.1, 0.2),
    ("micro_candle", "tiny_candle", "small_candle", "medium_candle"),
    "left",
)
ADX_BINS = (
    (15, 20, 30, 40),
    ("adx_very_weak", "adx_weak", "adx_optimal", "adx_strong", "adx_very_strong"),
    ("left", "left", "right", "right"),
)
ADX_BINS_HIGH = (
    (20, 25, 35, 50),
    ("adx_very_weak", "adx_weak", "adx_optimal", "adx_strong", "adx_very_strong"),
    "left",
)
VOLUME_BINS = (
    (0.5, 0.8, 1.2),
    ("very_low_volume", "low_volume", "normal_volume", "high_volume"),
    ("left", "left", "right"),
)
VOLUME_BINS_LEFT = (
    (0.5, 0.8, 1.2),
    ("very_low_volume", "low_volume", "normal_volume", "high_volume"),
    "left",
)
VOLUME_BINS_BALANCED = (
    (0.7, 1.0, 1.3),
    ("low_volume", "normal_volume", "high_volume", "spike_volume"),
    "left",
)


def candle_size(value=None, table=CANDLE_BINS) -> dict[str, Column]:
    return bucketize(body_pct() if value is None else value, *table)


def adx_level(value="adx", table=ADX_BINS) -> dict[str, Column]:
    return bucketize(value, *table)


def volume_level(value="volume_ratio", table=VOLUME_BINS) -> dict[str, Column]:
    return bucketize(value, *table)


def volume_extremes(value="volume_ratio") -> dict[str, Column]:
    return {"volume_spike": flag(c(value) > 1.5), "volume_dry": flag(c(value) < 0.7)}


# ------------------------------------------------------------------------------------ time

# Session times in minutes of the day.
OPEN_MINUTE = 555
WINDOW_1 = (555, 570)
WINDOW_2 = (600, 660)
FIRST_HOUR = (555, 615)
EOD_MINUTE = 915
LAST_ENTRY_MINUTE = 870


def minute_of_day(ts="ts") -> Column:
    return F.hour(c(ts)) * 60 + F.minute(c(ts))


def within(ts, window: tuple[int, int]) -> Column:
    return flag(minute_of_day(ts).between(*window))


def time_slot(ts="ts", size: int = 15) -> Column:
    return F.floor(minute_of_day(ts) / size)


def half_hour_slots(ts="ts", upper_inclusive: bool = True) -> dict[str, Column]:
    """Slots from 9:15 to 12:00. With ``upper_inclusive`` minute 30 ends a slot (and the first
    one starts at :15); otherwise slots are half-open and the first covers 9:00 to 9:30."""
    h, m = F.hour(c(ts)), F.minute(c(ts))
    if upper_inclusive:
        first, second = m.between(15, 30), m > 30
        third, fourth = m <= 30, m > 30
    else:
        first, second = m < 30, m >= 30
        third, fourth = m < 30, m >= 30
    return {
        "is_9_15_to_9_30": flag((h == 9) & first),
        "is_9_30_to_10_00": flag((h == 9) & second),
        "is_10_00_to_10_30": flag((h == 10) & third),
        "is_10_30_to_11_00": flag((h == 10) & fourth),
        "is_11_00_to_12_00": flag(h == 11),
    }


def time_columns(ts="ts", window_1=WINDOW_1, window_2=WINDOW_2) -> dict[str, Column]:
    """The default time feature group."""
    one, two = within(ts, window_1), within(ts, window_2)
    return {
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "time_minutes": minute_of_day(ts),
        "entry_window_1": one,
        "entry_window_2": two,
        "in_entry_window": F.greatest(one, two),
        "market_open_hour": flag(F.hour(ts) == 9),
        "first_hour": within(ts, FIRST_HOUR),
    }


def relaxed_windows(ts="ts") -> dict[str, Column]:
    h = F.hour(ts)
    one = flag((h == 9) & F.minute(ts).between(15, 60))
    two = flag(h.isin(10, 11))
    return {"entry_window_1": one, "entry_window_2": two, "in_entry_window": F.greatest(one, two)}


def session_columns(ts="ts") -> dict[str, Column]:
    h = F.hour(ts)
    return {
        "mid_session": flag(h.between(11, 13)),
        "last_hour": flag(h >= 15),
        "morning_session": flag((h >= 9) & (h < 12)),
        "afternoon_session": flag((h >= 12) & (h < 15)),
        "best_hours": flag((h >= 10) & (h < 14)),
        "trading_hours": flag(h.between(9, 15)),
    }


def calendar_columns(ts="ts") -> dict[str, Column]:
    """Weekday with Monday 0, and minutes since the 9:15 open."""
    return {
        "day_of_week": F.weekday(c(ts)),
        "minutes_since_open": minute_of_day(ts) - OPEN_MINUTE,
    }


# ------------------------------------------------------------------------------ indicators


def range_flags(rsi="rsi", adx="adx") -> dict[str, Column]:
    r, a = c(rsi), c(adx)
    return {
        "rsi_overbought": flag(r > 70),
        "rsi_oversold": flag(r < 30),
        "rsi_neutral": flag((r >= 40) & (r <= 60)),
        "adx_in_range": flag((a >= 20) & (a <= 36)),
    }


def interactions(**cols: str) -> dict[str, Column]:
    """Products of indicators; only those whose inputs are named."""
    have = {k: F.col(v) for k, v in cols.items()}

    def need(*names):
        return all(n in have for n in names)

    out = {}
    if need("dist", "adx"):
        out["trap_context"] = have["dist"] * have["adx"]
        out["ema_adx"] = have["dist"] * have["adx"] / 100
    if need("volume_ratio", "body"):
        out["volume_candle"] = have["volume_ratio"] * have["body"]
    if need("slot", "dist"):
        out["time_ema"] = have["slot"] * F.abs(have["dist"])
    if need("rsi", "volume_ratio"):
        out["rsi_volume_ratio"] = have["rsi"] * have["volume_ratio"]
    if need("rsi", "volatility"):
        out["rsi_volatility"] = have["rsi"] * have["volatility"]
    if need("volume_ratio", "dist"):
        out["volume_ema"] = have["volume_ratio"] * have["dist"]
    if need("rsi", "dist"):
        out["rsi_ema_divergence"] = (have["rsi"] - 50) * have["dist"]
    if need("macd_hist", "rsi"):
        out["macd_rsi"] = have["macd_hist"] * (have["rsi"] - 50) / 100
    return out


def composites(style: str = "near") -> dict[str, Column]:
    """Boolean composites; ``near`` asks for closeness to the average, ``trend`` for being above."""
    d, adx, vr = F.col("dist_pct"), F.col("adx"), F.col("volume_ratio")
    h = F.hour("ts")
    if style == "near":
        return {
            "ema_adx_signal": flag((adx >= 20) & (adx <= 36) & (F.abs(d) < 1.0)),
            "volume_candle_signal": flag((vr > 0.8) & (body_pct() > 0.15)),
            "time_ema_signal": flag(h.between(9, 14) & (F.abs(d) < 2.0)),
        }
    return {
        "ema_adx_signal": flag((d > 0) & (adx > 25)),
        "volume_candle_signal": flag((vr > 1.0) & (green() == 1)),
        "time_ema_signal": flag((h >= 10) & (h < 14) & (d > 0)),
    }


# Combination features, with the inputs each needs.
COMBINATIONS = {
    "rsi_macd_signal": ("rsi", "macd"),
    "trend_alignment": ("sma_20", "ema_12"),
    "bb_breakout": ("bb_position", "atr"),
    "volume_confirmation": ("volume_ratio_20", "obv"),
    "ema_cross": ("ema_12", "ema_26"),
}


def combination_columns(columns: Sequence[str]) -> dict[str, Column]:
    """Combination features whose inputs are among ``columns``."""
    exprs = {
        "rsi_macd_signal": lambda: (F.col("rsi") > 50) & (F.col("macd") > 0),
        "trend_alignment": lambda: (F.col("close") > F.col("sma_20"))
        & (F.col("close") > F.col("ema_12")),
        "bb_breakout": lambda: (F.col("bb_position") > 1.0) | (F.col("bb_position") < 0.0),
        "volume_confirmation": lambda: F.col("volume_ratio_20") > 1.5,
        "ema_cross": lambda: F.col("ema_12") > F.col("ema_26"),
    }
    have = set(columns)
    return {n: flag(exprs[n]()) for n, need in COMBINATIONS.items() if have.issuperset(need)}


def select_features(
    df: DataFrame,
    names: Sequence[str] | None = None,
    *,
    exclude: Sequence[str] = ("open", "high", "low", "close", "volume"),
    keys: Sequence[str] = ("symbol", "ts"),
) -> DataFrame:
    """Named features that exist, or every column that is not a bar column."""
    if names is None:
        return df.drop(*exclude)
    return df.select(*keys, *[n for n in names if n in df.columns])


def setup_quality(cols: Mapping[str, str] | None = None) -> dict[str, Column]:
    """Score 0-5 from trend alignment, volume, candle, hour and distance; 4 or more is high."""
    n = {
        "fast": "ema_8",
        "slow": "ema_30",
        "slope": "ema_30_slope_5",
        "spike": "volume_spike",
        "strong": "strong_candle",
        "hours": "best_hours",
        "dist": "price_distance_ema_8",
        **(cols or {}),
    }
    k = {a: F.col(b) for a, b in n.items()}
    up = (k["fast"] > k["slow"]) & (k["slope"] > 0)
    down = (k["fast"] < k["slow"]) & (k["slope"] < 0)
    score = (
        flag(up | down)
        + flag(k["spike"] > 1.2)
        + flag(k["strong"] == 1)
        + flag(k["hours"] == 1)
        + flag(F.abs(k["dist"]) < 0.01)
    )
    return {"setup_quality_score": score, "high_quality_setup": flag(score >= 4)}
