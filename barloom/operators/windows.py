"""Window features as steps of one blocked layout, and cumulative ones as running aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import body, correlation, div, flag, green, red
from barloom.plans.ordered import bucket_of, running
from barloom.plans.series import Step, chain, columns_step, over_series

# ------------------------------------------------------------------------ moving averages


def sma(col: str = "close", periods: Sequence[int] = (20,), prefix: str = "sma", back=0) -> Step:
    return columns_step(
        lambda f: {f"{prefix}_{n}": f.roll(F.avg, col, n) for n in periods},
        back=max(periods) - 1 + back,
        name="sma",
    )


def price_ratios(*averages: str, price="close") -> Step:
    """Price over each named average."""
    return columns_step(lambda f: {f"price_{a}_ratio": div(F.col(price), F.col(a)) for a in averages})


def pct_change(f, col, n: int = 1) -> Column:
    return div(F.col(col), f.lag(col, n)) - 1


def changes(
    col="close", periods: Sequence[int] = (1,), prefix="change", scale: float = 1.0, back=0
) -> Step:
    """Relative change against n rows before."""
    return columns_step(
        lambda f: {f"{prefix}_{n}": pct_change(f, col, n) * scale for n in periods},
        back=max(periods) + back,
    )


def differences(col, periods=(1,), prefix="diff", back=0) -> Step:
    return columns_step(
        lambda f: {f"{prefix}_{n}": F.col(col) - f.lag(col, n) for n in periods},
        back=max(periods) + back,
    )


def lags(cols: Sequence[str], periods: Sequence[int] = (1, 2, 3), back=0) -> Step:
    return columns_step(
        lambda f: {f"{x}_lag_{n}": f.lag(x, n) for x in cols for n in periods},
        back=max(periods) + back,
    )


def momentum_mean(col, n=3, out="momentum", back=0) -> Step:
    return columns_step(lambda f: {out: f.roll(F.avg, col, n)}, back=n - 1 + back)


# --------------------------------------------------------------------------- volatility


def volatility(periods: Sequence[int] = (20,), scale: float = 1.0, returns="returns") -> Step:
    """Returns and their rolling sample deviation."""
    return chain(
        columns_step(lambda f: {returns: pct_change(f, "close")}, back=1),
        columns_step(
            lambda f: {f"volatility_{n}": f.roll(F.stddev_samp, returns, n) * scale for n in periods},
            back=max(periods) - 1,
        ),
    )


def volatility_ratio(n: int = 20, over: int | None = None, col: str | None = None, back=None) -> Step:
    """Volatility against its own mean over ``over`` rows (2n by default)."""
    m = over or 2 * n
    v = col or f"volatility_{n}"
    return columns_step(
        lambda f: {"volatility_ratio": div(F.col(v), f.roll(F.avg, v, m))},
        back=(n if back is None else back) + m - 1,
    )


def bollinger(n: int = 20, k: float = 2.0, col="close") -> Step:
    """Middle, bands, relative width and position; sample deviation is the contract."""

    def mid(f):
        return {"bb_middle": f.roll(F.avg, col, n), "_sd": f.roll(F.stddev_samp, col, n)}

    def build(df, f):
        df = df.withColumns(mid(f))
        up, low = F.col("bb_middle") + F.col("_sd") * k, F.col("bb_middle") - F.col("_sd") * k
        return df.withColumns(
            {
                "bb_upper": up,
                "bb_lower": low,
                "bb_width": div(up - low, F.col("bb_middle")),
                "bb_position": div(F.col(col) - low, up - low),
            }
        ).drop("_sd")

    return Step(build, n - 1, 0, "bollinger")


def bollinger_touches() -> Step:
    return columns_step(
        lambda f: {
            "bb_upper_touch": flag(F.col("high") >= F.col("bb_upper")),
            "bb_lower_touch": flag(F.col("low") <= F.col("bb_lower")),
        }
    )


def true_range(f) -> Column:
    """Null on the first row, which has no previous close."""
    p = f.lag("close")
    tr = F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p)
    )
    return F.when(p.isNotNull(), tr)


def atr_sma(n: int = 14, out="atr") -> Step:
    def build(df, f):
        df = df.withColumn("true_range", true_range(f))
        return df.withColumn(out, f.roll(F.avg, "true_range", n))

    return Step(build, n, 0, "atr_sma")


# ---------------------------------------------------------------------------- oscillators


def _raw_k(f, n) -> Column:
    lo, hi = f.roll(F.min, "low", n), f.roll(F.max, "high", n)
    return div(F.col("close") - lo, hi - lo) * 100


def stochastic(k: int = 14, d: int = 3, smooth_k: int = 1) -> Step:
    """%K and %D; ``smooth_k`` > 1 gives the slow form."""

    def build(df, f):
        df = f.with_columns(df, {"stoch_k": _raw_k(f, k)})
        if smooth_k > 1:
            df = df.withColumn("stoch_k", f.roll(F.avg, "stoch_k", smooth_k))
        return df.withColumn("stoch_d", f.roll(F.avg, "stoch_k", d))

    return Step(build, k + d + smooth_k, 0, "stochastic")


def williams_r(n: int = 14) -> Step:
    def cols(f):
        lo, hi = f.roll(F.min, "low", n), f.roll(F.max, "high", n)
        return {"williams_r": div(hi - F.col("close"), hi - lo) * -100}

    return columns_step(cols, back=n - 1)


def rsi_sma(n: int = 14, out="rsi") -> Step:
    """RSI with plain means of gains and losses; a first change that is missing counts as 0."""

    def build(df, f):
        diff = F.col("close") - f.lag("close")
        df = df.withColumns(
            {
                "_gain": F.when(diff > 0, diff).otherwise(0.0),
                "_loss": F.when(diff < 0, -diff).otherwise(0.0),
            }
        )
        df = df.withColumns({"_g": f.roll(F.avg, "_gain", n), "_l": f.roll(F.avg, "_loss", n)})
        value = F.when(F.col("_l") == 0, F.when(F.col("_g") > 0, 100.0)).otherwise(
            F.lit(100.0) - F.lit(100.0) / (F.col("_g") / F.col("_l") + 1)
        )
        return df.withColumn(out, value).drop("_gain", "_loss", "_g", "_l")

    return Step(build, n, 0, "rsi_sma")


# ------------------------------------------------------------------------- events, swings


def event_counts(cols: Sequence[str], periods: Sequence[int] = (5, 10), back=0) -> Step:
    """How often each flag was set in the last n rows."""
    return columns_step(
        lambda f: {f"{x}_last_{n}": f.roll(F.sum, x, n) for x in cols for n in periods},
        back=max(periods) - 1 + back,
    )


def swings(periods: Sequence[int] = (5, 10, 20), dist: Sequence[int] = (10,)) -> Step:
    """Swing highs and lows, and relative distances to them."""

    def build(df, f):
        cols = {}
        for n in periods:
            cols[f"swing_high_{n}"] = f.roll(F.max, "high", n)
            cols[f"swing_low_{n}"] = f.roll(F.min, "low", n)
        df = f.with_columns(df, cols)
        close = F.col("close")
        return df.withColumns(
            {
                **{f"to_swing_high_{n}": div(F.col(f"swing_high_{n}") - close, close) for n in dist},
                **{f"to_swing_low_{n}": div(close - F.col(f"swing_low_{n}"), close) for n in dist},
            }
        )

    return Step(build, max(periods) - 1, 0, "swings")


def near_extremes(n: int = 5, tol: float = 0.005) -> Step:
    return columns_step(
        lambda f: {
            "near_high": flag(F.col("close") >= f.roll(F.max, "high", n) * (1 - tol)),
            "near_low": flag(F.col("close") <= f.roll(F.min, "low", n) * (1 + tol)),
        },
        back=n - 1,
    )


def recent_range(n: int = 20) -> Step:
    return columns_step(
        lambda f: {
            f"range_{n}_pct": div(
                f.roll(F.max, "high", n) - f.roll(F.min, "low", n), F.col("close")
            )
            * 100
        },
        back=n - 1,
    )


def strong_candle(periods: Sequence[int] = (20,)) -> Step:
    """Body relative to close above its rolling mean."""

    def build(df, f):
        df = df.withColumn("body_size", div(body(), F.col("close")))
        return df.withColumns(
            {
                f"strong_candle_{n}": flag(F.col("body_size") > f.roll(F.avg, "body_size", n))
                for n in periods
            }
        )

    return Step(build, max(periods) - 1, 0, "strong_candle")


def volume_features(n: int = 20, slow: int = 50) -> Step:
    """Volume means, ratio (also called spike), rate of change and trend."""

    def build(df, f):
        df = df.withColumns(
            {
                f"volume_ma{n}": f.roll(F.avg, "volume", n),
                f"volume_ma{slow}": f.roll(F.avg, "volume", slow),
                "volume_roc": pct_change(f, "volume"),
            }
        )
        return df.withColumns(
            {
                "volume_ratio": div(F.col("volume"), F.col(f"volume_ma{n}")),
                "volume_spike": F.col("volume") / (F.col(f"volume_ma{n}") + 1e-10),
                "volume_trend": F.col(f"volume_ma{n}") / (F.col(f"volume_ma{slow}") + 1e-10),
            }
        )

    return Step(build, slow - 1, 0, "volume")


def volume_price_trend(spike="volume_spike", strong="strong_candle_20") -> Column:
    return flag((F.col(spike) > 1.2) & (F.col(strong) == 1))


def rolling_corr(a="volume", b="close", n: int = 20, out="volume_price_corr") -> Step:
    def cols(f):
        frame = f.rows(-(n - 1), 0)
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        full = F.count(F.when(both, 1)).over(frame) == n
        return {out: F.when(full, correlation(a, b, frame))}

    return columns_step(cols, back=n - 1)


# ---------------------------------------------------------------------- averages and price


def slopes(cols: Sequence[str], periods: Sequence[int] = (3, 5), back=0) -> Step:
    """diff(n) / shift(n)."""
    return columns_step(
        lambda f: {
            f"{x}_slope_{n}": div(F.col(x) - f.lag(x, n), f.lag(x, n)) for x in cols for n in periods
        },
        back=max(periods) + back,
    )


def acceleration(cols: Sequence[str], n: int = 3, back=0) -> Step:
    """Change of the slope; needs ``slopes`` first."""
    return columns_step(
        lambda f: {f"{x}_acceleration": F.col(f"{x}_slope_{n}") - f.lag(f"{x}_slope_{n}") for x in cols},
        back=n + 1 + back,
    )


def cross_flags(a: str, b: str, up="cross_above", down="cross_below", back=0) -> Step:
    """``a`` crosses ``b``: at or beyond it before, strictly past it now."""
    x, y = F.col(a), F.col(b)
    return columns_step(
        lambda f: {
            up: flag((f.lag(a) <= f.lag(b)) & (x > y)),
            down: flag((f.lag(a) >= f.lag(b)) & (x < y)),
        },
        back=1 + back,
    )


def spread_features(fast="ema_8", slow="ema_30", back=0) -> Step:
    """Spread relative to price, its change, and which average is above."""

    def build(df, f):
        df = df.withColumns(
            {
                "ema_spread": div(F.col(fast) - F.col(slow), F.col("close")),
                "fast_above": flag(F.col(fast) > F.col(slow)),
            }
        )
        return df.withColumn("ema_spread_roc", F.col("ema_spread") - f.lag("ema_spread"))

    return Step(build, 1 + back, 0, "spread")


def price_position(fast="ema_8", slow="ema_30", tol=0.002) -> Step:
    """0 below both averages, 2 above both, else 1; distances and near flags."""
    close, x, y = F.col("close"), F.col(fast), F.col(slow)

    def cols(f):
        dx, dy = div(close - x, close), div(close - y, close)
        return {
            "price_position": F.when((close < x) & (close < y), 0)
            .when((close > x) & (close > y), 2)
            .otherwise(1),
            f"price_distance_{fast}": dx,
            f"price_distance_{slow}": dy,
            f"near_{fast}": flag(F.abs(dx) < tol),
            f"near_{slow}": flag(F.abs(dy) < tol),
        }

    return columns_step(cols)


def crossover_signals(slow="ema_30", strong="strong_candle_20") -> Step:
    """Crossings confirmed by slope and volume; retests of the slow average."""
    k = {n: F.col(n) for n in ("cross_above", "cross_below", f"{slow}_slope_5", "volume_spike",
                               "price_position", f"near_{slow}", strong)}
    slope, spike = k[f"{slow}_slope_5"], k["volume_spike"]
    near, hard = k[f"near_{slow}"] == 1, k[strong] == 1
    return columns_step(
        lambda f: {
            "bullish_cross_signal": flag((k["cross_above"] == 1) & (slope > 0) & (spike > 1.1)),
            "bearish_cross_signal": flag((k["cross_below"] == 1) & (slope < 0) & (spike > 1.1)),
            "bullish_retest_signal": flag((k["price_position"] == 0) & near & (green() == 1) & hard),
            "bearish_retest_signal": flag((k["price_position"] == 2) & near & (red() == 1) & hard),
        }
    )


def trap_flags(above="cross_above", below="cross_below", lookback: int = 10, back=0, exact=False) -> Step:
    """Set-up is a crossing; a trap is confirmed by the opposite crossing within ``lookback`` rows
    before (with ``exact``, exactly that many rows before)."""

    def cols(f):
        frame = f.rows(-lookback, -lookback if exact else -1)
        return {
            "bearish_trap_setup": F.col(above),
            "bullish_trap_setup": F.col(below),
            "bearish_trap": flag((F.col(below) == 1) & (F.max(above).over(frame) == 1)),
            "bullish_trap": flag((F.col(above) == 1) & (F.max(below).over(frame) == 1)),
        }

    return columns_step(cols, back=lookback + back)


def confirmed_signal(signal="signal", out="confirmed") -> Step:
    """Signal now and on the row before; the very first row needs no confirmation."""
    return columns_step(
        lambda f: {out: flag((F.col(signal) == 1) & ((f.rn == 1) | (f.lag(signal) == 1)))}, back=1
    )


def slope_filter(average="ema_50", n: int = 5, out="slope_ok", back=0) -> Step:
    """Average rose over n rows; not applied to the first n rows of the table."""
    return columns_step(
        lambda f: {out: (f.rn <= n) | F.coalesce(F.col(average) > f.lag(average, n), F.lit(False))},
        back=n + back,
    )


# ----------------------------------------------------------------------------- cumulative


def on_balance_volume(df: DataFrame, *, keys=("symbol",), ts="ts", first_sign=1.0, width=None) -> DataFrame:
    """Running volume signed by the close change; the first bar takes ``first_sign``."""
    step = columns_step(
        lambda f: {"_sv": F.coalesce(F.signum(F.col("close") - f.lag("close")), F.lit(first_sign))
                   * F.col("volume")},
        back=1,
    )
    out = over_series(df, step, keys=keys, order=ts)
    return running(out, {"obv": ("sum", F.col("_sv"))}, keys=keys, order=ts, width=width).drop("_sv")


def obv_trend(n: int = 20) -> Step:
    def build(df, f):
        df = df.withColumn("obv_sma", f.roll(F.avg, "obv", n))
        return df.withColumn("obv_trend", flag(F.col("obv") > F.col("obv_sma")))

    return Step(build, n - 1, 0, "obv_trend")


def price_volume_trend(df: DataFrame, *, keys=("symbol",), ts="ts", width=None) -> DataFrame:
    """Running volume times fractional return."""
    step = columns_step(lambda f: {"_pv": pct_change(f, "close") * F.col("volume")}, back=1)
    out = over_series(df, step, keys=keys, order=ts)
    return running(out, {"pvt": ("sum", F.col("_pv"))}, keys=keys, order=ts, width=width).drop("_pv")


def cumulative_pnl(
    df: DataFrame, value="pnl_pct", *, keys=("symbol",), order="exit_time", ties=(), width=None
) -> DataFrame:
    """Running total, its running peak and the drawdown below it."""
    out = running(
        df, {"cum_pnl": ("sum", F.col(value))}, keys=keys, order=order, ties=ties, width=width
    )
    out = running(
        out, {"peak": ("max", F.col("cum_pnl"))}, keys=keys, order=order, ties=ties, width=width
    )
    return out.withColumn("drawdown", F.col("cum_pnl") - F.col("peak"))


def max_drawdown(
    df, value="pnl_pct", *, keys=("symbol",), order="exit_time", ties=(), width: int | None = None
) -> DataFrame:
    """Deepest fall of the running total below its peak, per key, in one pass. A bucket reduces to its
    sum, highest and lowest running total and deepest fall; buckets in a row make one such state."""
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_b").orderBy(*[F.col(c) for c in (order, *ties)])
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*dict.fromkeys([*keys, order, *ties, value]), bucket_of(df, order, width).alias("_b"))
    rows = rows.withColumn("_s", F.sum(value).over(so_far)).withColumn("_p", F.max("_s").over(so_far))
    states = rows.groupBy(*keys, "_b").agg(
        F.sum(value).alias("_sum"),
        F.max("_s").alias("_top"),
        F.min("_s").alias("_low"),
        F.min(F.col("_s") - F.col("_p")).alias("_fall"),
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("_o", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    states = states.withColumn("_peak", F.max(F.col("_o") + F.col("_top")).over(before))
    deepest = F.least("_fall", F.col("_o") + F.col("_low") - F.col("_peak"))
    return states.groupBy(*keys).agg(F.min(deepest).alias("max_drawdown"))
