"""Indicators built on exponential smoothing.

Contract: averages start from the first value (``seed="first"``) or from the mean of the first n
values (``seed="sma"``, null before). Wilder smoothing is the same recurrence with weight 1/n. A
missing value keeps the average, and later values count for more by the gap, however many rows are
missing (``plans.series.smooth_gappy``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from barloom.functions.scalars import div, flag
from barloom.operators.windows import true_range
from barloom.plans.series import Phase, Smooth, Step, ema_history, ema_step, recursive_step, span_alpha, wilder_alpha


def ema(col="close", periods: Sequence[int] = (21,), *, seed="first", adjusted=False, prefix="ema") -> Step:
    return ema_step(
        {
            f"{prefix}_{n}": Smooth(col, span_alpha(n), adjusted=adjusted, sma_seed=n if seed == "sma" else 0)
            for n in periods
        }
    )


def ema_back(n: int) -> int:
    return ema_history(span_alpha(n))


def wilder(col: str, n: int = 14, out: str | None = None, lead: int = 0) -> Step:
    return ema_step({out or f"{col}_rma_{n}": Smooth(col, wilder_alpha(n), lead=lead)})


def macd(fast=12, slow=26, signal=9, *, adjusted=False, col="close") -> Step:
    """Line, signal line, histogram and which side the line is on."""
    lines = {
        "_mf": Smooth(col, span_alpha(fast), adjusted=adjusted),
        "_ms": Smooth(col, span_alpha(slow), adjusted=adjusted),
    }

    def line(df, f):
        return df.withColumn("macd", F.col("_mf") - F.col("_ms")).drop("_mf", "_ms")

    def sides(df, f):
        return df.withColumns(
            {
                "macd_hist": F.col("macd") - F.col("macd_signal"),
                "macd_bullish": flag(F.col("macd") > F.col("macd_signal")),
                "macd_bearish": flag(F.col("macd") < F.col("macd_signal")),
            }
        )

    signal_line = {"macd_signal": Smooth("macd", span_alpha(signal), adjusted=adjusted)}
    return recursive_step([Phase(outs=lines), Phase(line), Phase(outs=signal_line), Phase(sides)], [col], "macd")


def rsi(periods: Sequence[int] = (14,)) -> Step:
    """Relative strength from Wilder averages of gains and losses."""

    def moves(df, f):
        diff = F.col("close") - f.lag("close")
        known = diff.isNotNull()
        return df.withColumns(
            {
                "_up": F.when(known, F.greatest(diff, F.lit(0.0))),
                "_dn": F.when(known, F.greatest(-diff, F.lit(0.0))),
            }
        )

    outs = {}
    for n in periods:
        outs[f"_g{n}"] = Smooth("_up", wilder_alpha(n), lead=1, skip=1)
        outs[f"_l{n}"] = Smooth("_dn", wilder_alpha(n), lead=1, skip=1)

    def ratio(df, f):
        return df.withColumns(
            {f"rsi_{n}": div(F.col(f"_g{n}"), F.col(f"_g{n}") + F.col(f"_l{n}")) * 100 for n in periods}
        ).drop("_up", "_dn", *outs)

    return recursive_step([Phase(moves, back=1), Phase(outs=outs), Phase(ratio)], ["close"], "rsi")


def rsi_momentum(col="rsi_14", n: int = 3, back: int | None = None) -> Step:
    """Change of the RSI over one and over n rows."""
    hist = 1 + ema_history(wilder_alpha(14)) if back is None else back
    return Step(
        lambda df, f: df.withColumns(
            {"rsi_change": F.col(col) - f.lag(col), "rsi_momentum": F.col(col) - f.lag(col, n)}
        ),
        hist + n,
    )


def atr(n: int = 14, out="atr") -> Step:
    """Average true range, and as percent of the close."""

    def ranges(df, f):
        return df.withColumn("true_range", true_range(f))

    def percent(df, f):
        return df.withColumn(f"{out}_pct", div(F.col(out), F.col("close")) * 100)

    outs = {out: Smooth("true_range", wilder_alpha(n), lead=1, skip=1)}
    return recursive_step(
        [Phase(ranges, back=1), Phase(outs=outs), Phase(percent)], ["high", "low", "close"], "atr"
    )


def adx(n: int = 14) -> Step:
    """Directional movement: +DI, -DI and their smoothed contrast."""
    a = wilder_alpha(n)

    def moves(df, f):
        up = F.col("high") - f.lag("high")
        down = f.lag("low") - F.col("low")
        return df.withColumns(
            {
                "_pdm": F.when((up > down) & (up > 0), up).when((up + down).isNotNull(), 0.0),
                "_mdm": F.when((down > up) & (down > 0), down).when((up + down).isNotNull(), 0.0),
                "_tr": true_range(f),
            }
        )

    def contrast(df, f):
        df = df.withColumns(
            {
                "plus_di": div(F.col("_pdms"), F.col("_trs")) * 100,
                "minus_di": div(F.col("_mdms"), F.col("_trs")) * 100,
            }
        )
        total = F.col("plus_di") + F.col("minus_di")
        dx = F.coalesce(div(F.abs(F.col("plus_di") - F.col("minus_di")), total) * 100, F.lit(0.0))
        return df.withColumn("_dx", F.when(f.rn > 1, dx)).drop("_pdm", "_mdm", "_tr", "_pdms", "_mdms", "_trs")

    def change(df, f):
        return df.withColumn("adx_change", F.col("adx") - f.lag("adx")).drop("_dx")

    return recursive_step(
        [
            Phase(moves, back=1),
            Phase(outs={f"{x}s": Smooth(x, a, lead=1, skip=1) for x in ("_pdm", "_mdm", "_tr")}),
            Phase(contrast),
            Phase(outs={"adx": Smooth("_dx", a, lead=1)}),
            Phase(change, back=1),
        ],
        ["high", "low", "close"],
        "adx",
    )


def distance(average="ema_21", out="dist") -> Step:
    """Price above / below the average, and the distance in points and percent."""
    d = F.col("close") - F.col(average)
    return Step(
        lambda df, f: df.withColumns(
            {
                f"price_above_{average}": flag(d > 0),
                f"price_below_{average}": flag(d < 0),
                out: d,
                f"{out}_pct": div(d, F.col(average)) * 100,
            }
        )
    )


def ordering(*averages: str) -> Step:
    """0/1 for each neighbouring pair: the faster average lies above the slower."""
    pairs = list(zip(averages, averages[1:], strict=False))
    return Step(
        lambda df, f: df.withColumns({f"{a}_above_{b}": flag(F.col(a) > F.col(b)) for a, b in pairs})
    )
