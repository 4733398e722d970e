"""Forward-looking labels. Every label is a step: it needs ``ahead`` rows of the future."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import correlation, div, flag
from barloom.operators.metrics import breakdown, count_if
from barloom.operators.windows import pct_change, true_range
from barloom.plans.barriers import Touch, earlier, first_hit, first_touches, path
from barloom.plans.ordered import null_safe_join, with_position
from barloom.plans.series import Step, columns_step


def forward_return(f, k: int, col="close") -> Column:
    return div(f.lead(col, k), F.col(col)) - 1


def _threshold(r: Column, up: float, down: float) -> Column:
    return F.when(r <= down, -1).when(r >= up, 1).otherwise(0)


def next_period(k: int = 1, up: float = 0.01, down: float = -0.01) -> Step:
    """Sign of the return k rows ahead; rows without a future stay 0 and are kept."""
    return columns_step(
        lambda f: {
            "future_return": forward_return(f, k),
            "target": _threshold(forward_return(f, k), up, down),
            "target_binary": flag(_threshold(forward_return(f, k), up, down) == 1),
        },
        ahead=k,
    )


def fixed_horizon(k: int = 5, up: float = 0.02, down: float = -0.02) -> Step:
    """Highest high and lowest low of the next k rows. When both thresholds are passed the larger
    move wins, a tie is 0. The first k-1 rows look only from row k+1 of the series on."""

    def build(df, f):
        # Rows before the series' row k+1 do not count: this only bites on the first k-1 rows.
        hi = F.when(f.rn > k, F.col("high"))
        lo = F.when(f.rn > k, F.col("low"))
        best = div(F.max(hi).over(f.rows(1, k)), F.col("close")) - 1
        worst = div(F.min(lo).over(f.rows(1, k)), F.col("close")) - 1
        df = df.withColumns({"future_max_return": best, "future_min_return": worst})
        gain, loss = F.col("future_max_return"), F.col("future_min_return")
        won = F.coalesce(gain >= up, F.lit(False))
        lost = F.coalesce(loss <= down, F.lit(False))
        both = F.when(F.abs(gain) > F.abs(loss), 1).when(F.abs(loss) > F.abs(gain), -1).otherwise(0)
        target = F.when(won & lost, both).when(won, 1).when(lost, -1).otherwise(0)
        return df.withColumns({"target": target, "target_binary": flag(target == 1)})

    return Step(build, 0, k, "fixed_horizon")


def trap_entry(
    k: int = 2,
    up: float = 0.004,
    down: float = -0.004,
    *,
    window="in_entry_window",
    adx="adx_in_range",
    candle="small_candle",
) -> Step:
    """Entries where a confirmed trap meets the time window, trend and candle conditions, and
    whether the return k rows ahead pays in the entry's direction."""

    def cols(f):
        ok = (F.col(window) == 1) & (F.col(adx) == 1) & (F.col(candle) == 1)
        bear, bull = flag((F.col("bearish_trap") == 1) & ok), flag((F.col("bullish_trap") == 1) & ok)
        r = forward_return(f, k)
        paid_down = (bear == 1) & F.coalesce(r <= down, F.lit(False))
        paid_up = (bull == 1) & F.coalesce(r >= up, F.lit(False))
        return {
            "bearish_entry": bear,
            "bullish_entry": bull,
            "any_entry": F.greatest(bear, bull),
            "future_return": r,
            "target": F.when(paid_up, 1).when(paid_down, -1).otherwise(0),
            "target_binary": flag(paid_up | paid_down),
        }

    return columns_step(cols, ahead=k)


def any_horizon(
    horizons: Sequence[int] = (1, 2, 3),
    threshold: float = 0.001,
    bear: str = "bearish_entry",
    bull: str = "bullish_entry",
) -> Step:
    """1 when any of the horizons pays in the entry's direction."""

    def cols(f):
        down = up = F.lit(False)
        for k in horizons:
            r = forward_return(f, k)
            down = down | F.coalesce(r <= -threshold, F.lit(False))
            up = up | F.coalesce(r >= threshold, F.lit(False))
        won = ((F.col(bear) == 1) & down) | ((F.col(bull) == 1) & up)
        return {"target": flag(won)}

    return columns_step(cols, ahead=max(horizons))


def movement(k: int = 2, threshold: float = 0.002) -> Step:
    """1 when the next k rows move by the threshold either way; the direction is set when only one
    side does. Frames must be full: the first k-1 rows are 0, the last k rows are dropped."""

    def build(df, f):
        known = f.rn >= k
        best = F.when(known, div(f.next_agg(F.max, "high", k, full=True), F.col("close")) - 1)
        worst = F.when(known, div(f.next_agg(F.min, "low", k, full=True), F.col("close")) - 1)
        df = df.withColumns(
            {
                "future_return": forward_return(f, k),
                "future_max_return": best,
                "future_min_return": worst,
            }
        ).filter(F.col("future_return").isNotNull())
        up = flag(F.col("future_max_return") >= threshold)
        down = flag(F.col("future_min_return") <= -threshold)
        return df.withColumns({"target": F.greatest(up, down), "direction": up - down})

    return Step(build, 0, k, "movement")


def threshold_family(horizons: Sequence[int] = (1, 3, 5), thresholds: Sequence[float] = (0.002, 0.003, 0.005)) -> Step:
    """Up, down and movement flags for every horizon and threshold (named in basis points)."""

    def cols(f):
        out = {}
        for k in horizons:
            r = forward_return(f, k)
            for t in thresholds:
                tag = f"{round(t * 10_000)}bp_{k}"
                out[f"up_{tag}"] = flag(r > t)
                out[f"down_{tag}"] = flag(r < -t)
                out[f"move_{tag}"] = flag(F.abs(r) > t)
        return out

    return columns_step(cols, ahead=max(horizons))


def high_volatility(n: int = 20, k: int = 3, factor: float = 1.5) -> Step:
    """Deviation of the next k returns above ``factor`` times that of the last n."""

    def build(df, f):
        df = df.withColumn("_ret", pct_change(f, "close"))
        df = df.withColumns(
            {
                "recent_volatility": f.roll(F.stddev_samp, "_ret", n),
                "next_volatility": F.when(
                    f.rn >= k, f.next_agg(F.stddev_samp, "_ret", k, full=True)
                ),
            }
        )
        hot = F.col("next_volatility") > F.col("recent_volatility") * factor
        return df.withColumn("target_high_volatility", flag(hot)).drop("_ret")

    return Step(build, n, k, "high_volatility")


def trend_continuation(col="ema_spread", k: int = 5) -> Step:
    """Sign of the spread is the same k rows later."""
    return columns_step(
        lambda f: {"target_trend": flag(F.signum(col) == F.signum(f.lead(col, k)))}, ahead=k
    )


def valid_crossover(col="ema_spread", up="cross_above", down="cross_below", k: int = 3, edge: int = 5) -> Step:
    """A crossing whose mean spread over the next k rows goes beyond the present one. The first
    and last ``edge`` rows are 0."""

    def cols(f):
        ahead = F.avg(col).over(f.rows(1, k))
        good = ((F.col(up) == 1) & (ahead > F.col(col))) | ((F.col(down) == 1) & (ahead < F.col(col)))
        inside = (f.rn > edge) & f.lead("_rn", edge).isNotNull()
        return {"target_valid_cross": flag(good & inside)}

    return columns_step(cols, ahead=max(k, edge))


def triple_barrier(
    horizon: int = 10, profit: float = 1.5, loss: float = 1.5, atr="atr", keep_tail: bool = False
) -> Step:
    """1 iff the upper barrier is touched no later than the lower one within the horizon. Rows
    without a full horizon are dropped."""

    def build(df, f):
        df = df.withColumn("_path", path(f, ("high", "low"), horizon))
        top = F.col("close") + F.col(atr) * profit
        bottom = F.col("close") - F.col(atr) * loss
        df = df.withColumns(
            {
                "_up": first_hit(F.col("_path"), lambda b: b["high"] >= top),
                "_dn": first_hit(F.col("_path"), lambda b: b["low"] <= bottom),
            }
        )
        df = df.withColumn("target_binary", flag(earlier(F.col("_up"), F.col("_dn"), tie=True)))
        if not keep_tail:
            df = df.filter(F.size("_path") == horizon)
        return df.drop("_path", "_up", "_dn")

    return Step(build, 0, horizon, "triple_barrier")


def triple_barrier_far(
    df: DataFrame,
    horizon: int,
    profit: float = 1.5,
    loss: float = 1.5,
    atr="atr",
    keep_tail: bool = False,
    *,
    keys: Sequence[str] = ("symbol",),
    ts="ts",
    step: int | None = None,
) -> DataFrame:
    """``triple_barrier`` for horizons of hundreds or thousands of bars, which no row can carry along."""
    rows = with_position(df, keys=keys, order=ts).withColumns(
        {"_top": F.col("close") + F.col(atr) * profit, "_bottom": F.col("close") - F.col(atr) * loss}
    )
    rows = first_touches(
        rows,
        {"_up": Touch("high", "_top", True), "_dn": Touch("low", "_bottom", False)},
        horizon,
        keys=keys,
        order=ts,
        step=step,
    )
    rows = rows.withColumn("target_binary", flag(earlier(F.col("_up"), F.col("_dn"), tie=True)))
    if not keep_tail:
        last = rows.groupBy(*keys).agg(F.max("_rn").alias("_last"))
        rows = null_safe_join(rows, last, list(keys)).filter(F.col("_rn") <= F.col("_last") - horizon).drop("_last")
    return rows.drop("_rn", "_top", "_bottom", "_up", "_dn")


def swing_targets(
    rr: Sequence[float] = (1.0, 2.0), swing: int = 10, horizon: int = 20
) -> Step:
    """R-multiple targets with the stop at the swing of the ``swing`` rows before. The stop is
    tested first within a bar, so a win needs the target strictly earlier. The first ``swing``
    and last ``horizon`` rows stay 0."""

    def build(df, f):
        before = f.rows(-swing, -1)
        df = df.withColumns(
            {
                "_path": path(f, ("high", "low"), horizon),
                "_lo": F.min("low").over(before),
                "_hi": F.max("high").over(before),
            }
        )
        inside = (f.rn > swing) & (F.size("_path") == horizon)
        entry, lo, hi = F.col("close"), F.col("_lo"), F.col("_hi")
        stops = {
            "_ls": first_hit(F.col("_path"), lambda b: b["low"] <= lo),
            "_ss": first_hit(F.col("_path"), lambda b: b["high"] >= hi),
        }
        df = df.withColumns(stops)
        out = {}
        for r in rr:
            up, down = entry + (entry - lo) * r, entry - (hi - entry) * r
            lt = first_hit(F.col("_path"), lambda b, up=up: b["high"] >= up)
            st = first_hit(F.col("_path"), lambda b, down=down: b["low"] <= down)
            long_ok = inside & (entry > lo) & earlier(lt, F.col("_ls"), tie=False)
            short_ok = inside & (hi > entry) & earlier(st, F.col("_ss"), tie=False)
            out[f"target_long_{r:g}r"] = flag(long_ok)
            out[f"target_short_{r:g}r"] = flag(short_ok)
        return df.withColumns(out).drop("_path", "_lo", "_hi", "_ls", "_ss")

    return Step(build, swing, horizon, "swing_targets")


def atr_targets(
    rr: Sequence[float] = (1.0, 2.0),
    *,
    multiple: float = 1.5,
    n: int = 14,
    min_hold: int = 3,
    max_hold: int = 20,
    respect_stop: bool = False,
) -> Step:
    """Targets at rr times the stop distance, looked for from ``min_hold`` rows ahead.

    By default stops do not end a trade: a side wins iff its target is touched no later than the
    other side's. ``respect_stop`` makes a side's own stop count, tested after its target.
    """

    def build(df, f):
        df = df.withColumn("_tr", true_range(f))
        df = df.withColumn("_atr1", F.avg("_tr").over(f.rows(-(n - 1), 0)))
        df = df.withColumns(
            {"_atr": f.lag("_atr1"), "_path": path(f, ("high", "low"), max_hold, start=min_hold)}
        )
        full = f.lead("_rn", max_hold).isNotNull()
        inside = full & F.col("_atr").isNotNull() & (F.col("_atr") != 0)
        entry, dist = F.col("close"), F.col("_atr") * multiple
        p = F.col("_path")
        out = {}
        for r in rr:
            up = first_hit(p, lambda b, r=r: b["high"] >= entry + dist * r)
            down = first_hit(p, lambda b, r=r: b["low"] <= entry - dist * r)
            if respect_stop:
                low = first_hit(p, lambda b: b["low"] <= entry - dist)
                high = first_hit(p, lambda b: b["high"] >= entry + dist)
                won_l, won_s = earlier(up, low, tie=True), earlier(down, high, tie=True)
            else:
                won_l, won_s = earlier(up, down, tie=True), earlier(down, up, tie=True)
            out[f"target_long_{r:g}r"] = flag(inside & won_l)
            out[f"target_short_{r:g}r"] = flag(inside & won_s)
        return df.withColumns(out).drop("_tr", "_atr1", "_atr", "_path")

    return Step(build, n + 1, max_hold, "atr_targets")


def combined(rr: Sequence[float] = (1.0, 2.0)) -> dict[str, Column]:
    """Either side won, and the direction (short overwrites long)."""
    out = {}
    for r in rr:
        lo, sh = F.col(f"target_long_{r:g}r") == 1, F.col(f"target_short_{r:g}r") == 1
        out[f"target_combined_{r:g}r"] = flag(lo | sh)
        out[f"direction_{r:g}r"] = F.when(sh, -1).when(lo, 1).otherwise(0)
    return out


# ------------------------------------------------------------------------ label audits


def distribution(df: DataFrame, label="target", by: Sequence[str] = ()) -> DataFrame:
    return breakdown(df, label, by)


def validate(df: DataFrame, label="target", by: Sequence[str] = (), allowed=(-1, 0, 1), min_share=0.05, min_rows=100):
    """Row count, values outside the allowed set, rarest class, and the verdict."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    known = F.col(label).isNotNull()
    agg = n.groupBy(*by).agg(
        F.sum("_n").alias("rows"),
        F.sum(F.when(known & F.col(label).isin(list(allowed)), 0).otherwise(F.col("_n"))).alias("invalid"),
        F.min(F.when(known, F.col("_n"))).alias("_rare"),
        F.count(label).alias("classes"),
    )
    agg = agg.withColumn("rarest_share", F.col("_rare") / F.col("rows")).drop("_rare")
    warnings = F.array(
        F.when(F.col("rarest_share") < min_share, F.lit("imbalanced classes")),
        F.when(F.col("rows") < min_rows, F.lit("few rows")),
    )
    return agg.withColumns(
        {
            "warnings": F.filter(warnings, lambda w: w.isNotNull()),
            "is_valid": F.col("invalid") == 0,
        }
    )


# Name parts that betray a column computed from the future.
LEAK_WORDS = ("future", "next", "forward", "ahead", "target")


def leakage_audit(df: DataFrame, features: Sequence[str], target="target", by: Sequence[str] = ()) -> DataFrame:
    """Absolute correlation of each feature with the target and what it suggests."""
    aggs = [correlation(c, F.col(target).cast("double")).alias(f"c{i}") for i, c in enumerate(features)]
    one = df.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.abs(F.col(f"c{i}")).alias("abs_corr"),
                F.lit(any(w in c.lower() for w in LEAK_WORDS)).alias("future_name"),
            )
            for i, c in enumerate(features)
        ]
    )
    out = one.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")
    level = (
        F.when(F.col("abs_corr") > 0.95, "leak").when(F.col("abs_corr") > 0.8, "suspicious").otherwise("ok")
    )
    return out.withColumn("verdict", level)


def class_ratio(df, target="target", by: Sequence[str] = ()) -> DataFrame:
    agg = df.groupBy(*by).agg(
        count_if(F.col(target) == 1).alias("positives"), count_if(F.col(target) == 0).alias("negatives")
    )
    return agg.withColumn("ratio", div(F.col("positives"), F.col("negatives")))

