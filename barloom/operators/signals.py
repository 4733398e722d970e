"""Scores to signals, entry filters and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import EOD_MINUTE, LAST_ENTRY_MINUTE, OPEN_MINUTE, flag, minute_of_day
from barloom.operators.metrics import count_if
from barloom.plans.series import Step, columns_step

# Default thresholds of the signal rules.
BUY, SELL, MIN_CONFIDENCE = 0.55, 0.45, 0.6
SMOOTHING, MAJORITY = 3, 0.3


def raw_signal(prob="probability", buy: float = BUY, sell: float = SELL) -> Column:
    p = F.col(prob)
    return F.when(p >= buy, 1).when(p <= sell, -1).otherwise(0)


def confidence(prob="probability") -> Column:
    """Distance from a coin toss, 0 to 1."""
    return F.least(F.abs(F.col(prob) - 0.5) * 2, F.lit(1.0))


def confident_signal(prob="probability", minimum: float = MIN_CONFIDENCE, **kw) -> Column:
    return F.when(confidence(prob) < minimum, 0).otherwise(raw_signal(prob, **kw))


def volatility_column(columns: Sequence[str]) -> str | None:
    """First column that measures volatility."""
    return next((c for c in columns if "volatility" in c.lower() or "atr" in c.lower()), None)


def regime_filter(df: DataFrame, signal="signal", threshold: float = 0.05, features=None) -> DataFrame:
    """No signal while the first volatility feature is above the threshold."""
    vol = volatility_column(features or [c for c in df.columns if c != signal])
    if vol is None:
        return df
    return df.withColumn(signal, F.when(F.col(vol) > threshold, 0).otherwise(F.col(signal)))


def smoothed_signal(signal="signal", n: int = SMOOTHING, out="smoothed", majority=MAJORITY) -> Step:
    """Majority of the last n signals; passed through until there are n."""

    def cols(f):
        frame = f.rows(-(n - 1), 0)
        total, have = F.sum(signal).over(frame), F.count(signal).over(frame)
        vote = F.when(total > n * majority, 1).when(total < -n * majority, -1).otherwise(0)
        return {out: F.when(have < n, F.col(signal)).otherwise(vote)}

    return columns_step(cols, back=n - 1)


def signal_statistics(df: DataFrame, signal="signal", by: Sequence[str] = ()) -> DataFrame:
    s = F.col(signal)
    agg = df.groupBy(*by).agg(
        F.count(s).alias("total_signals"),
        count_if(s == 1).alias("buy_signals"),
        count_if(s == -1).alias("sell_signals"),
        count_if(s == 0).alias("hold_signals"),
    )
    share = {
        f"{n}_percentage": F.col(f"{n}_signals") * 100.0 / F.col("total_signals")
        for n in ("buy", "sell", "hold")
    }
    return agg.withColumns(share)


def recent_signals(df, signal="signal", n: int = 10, *, keys=("symbol",), ts="ts") -> DataFrame:
    """The last n signals of each key, oldest first. Rows are cut to the last n map-side by
    bucket before the final pick, so a key's history never meets in one task."""
    from pyspark.sql import Window

    from barloom.plans.ordered import bucket_of

    cut = df.select(*keys, ts, signal, bucket_of(df, ts).alias("_b"))
    w = Window.partitionBy(*keys, "_b").orderBy(F.col(ts).desc())
    cut = cut.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n)
    # A key has at most n rows per bucket left; buckets are days, so one more window is small.
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    cut = cut.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n)
    packed = F.array_sort(F.collect_list(F.struct(ts, signal)))
    return cut.groupBy(*keys).agg(F.transform(packed, lambda x: x[signal]).alias("recent_signals"))


def latest_row(df: DataFrame, *, keys=("symbol",), ts="ts") -> DataFrame:
    """Last row of each key, by a map-side combined maximum."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ts).alias("_r")).select(*keys, "_r.*")


def signal_struct(signal="signal", conf="confidence", ts="ts", features: Sequence[str] = ()) -> Column:
    """The signal record: class, confidence, time and the features behind it."""
    pairs = [x for c in features for x in (F.lit(c), F.col(c).cast("double"))]
    feats = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array(), F.array())
    return F.struct(
        F.col(signal).cast("int").alias("signal"),
        F.col(conf).cast("double").alias("confidence"),
        F.col(ts).alias("ts"),
        feats.alias("features"),
    )


def soft_vote(probs: Sequence[str]) -> Column:
    """Mean probability."""
    return sum((F.col(p) for p in probs[1:]), F.col(probs[0])) / len(probs)


def hard_vote(preds: Sequence[str], need: int = 1) -> Column:
    """At least ``need`` models say yes."""
    return flag(sum((F.col(p) for p in preds[1:]), F.col(preds[0])) >= need)


# ---------------------------------------------------------------------------- entry filters


def entry_conditions(
    *,
    min_prob=None,
    min_adx=None,
    window: tuple[int, int] | None = None,
    not_from: int | None = None,
    min_volume=None,
    strong_green: bool = False,
    min_body: float = 0.15,
    min_range=None,
    slope_ok: str | None = None,
    ts="ts",
) -> dict[str, Column]:
    """Named entry conditions; those not asked for are left out. Limits may be grid columns."""
    m, out = minute_of_day(ts), {}
    if min_prob is not None:
        out["prob"] = F.col("probability") >= min_prob
    if min_adx is not None:
        out["adx"] = F.col("adx") >= min_adx
    if window is not None:
        out["window"] = m.between(*window)
    if not_from is not None:
        out["not_late"] = m < not_from
    if min_volume is not None:
        out["volume"] = F.col("volume_ratio") >= min_volume
    if strong_green:
        close, mid = F.col("close"), (F.col("high") + F.col("low")) / 2
        body = (close - F.col("open")) / F.col("open") * 100
        out["candle"] = (close > F.col("open")) & (body >= min_body) & (close >= mid)
    if min_range is not None:
        out["range"] = F.col("range_20_pct") >= min_range
    if slope_ok is not None:
        out["slope"] = F.col(slope_ok)
    return out


def market_hours(ts="ts") -> dict[str, Column]:
    """Default entry hours: the session, but not its last part."""
    return entry_conditions(window=(OPEN_MINUTE, EOD_MINUTE), not_from=LAST_ENTRY_MINUTE, ts=ts)


def all_of(conds: Mapping[str, Column]) -> Column:
    out = F.lit(True)
    for c in conds.values():
        out = out & F.coalesce(c, F.lit(False))
    return out


def entry_signal(**kw) -> Column:
    return flag(all_of(entry_conditions(**kw)))


def funnel(df: DataFrame, conds: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """How many rows pass each condition alone and together with those before it."""
    aggs, so_far = [F.count(F.lit(1)).alias("_all")], F.lit(True)
    for n, c in conds.items():
        c = F.coalesce(c, F.lit(False))
        so_far = so_far & c
        aggs += [count_if(c).alias(f"a_{n}"), count_if(so_far).alias(f"s_{n}")]
    one = df.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.lit(n).alias("condition"),
                F.col(f"a_{n}").alias("alone"),
                F.col(f"s_{n}").alias("passed"),
                (F.col(f"s_{n}") * 100.0 / F.col("_all")).alias("pct"),
            )
            for i, n in enumerate(conds)
        ]
    )
    return one.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def profitability(
    entries: DataFrame, returns: Sequence[str], thresholds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Per threshold and horizon: entries whose absolute return reached it. One pass: the grid is
    a literal array, and counts are combined map-side."""
    aggs = [F.count(F.lit(1)).alias("entries")]
    cells = []
    for r in returns:
        for t in thresholds:
            aggs.append(count_if(F.abs(F.col(r)) >= t).alias(f"h{len(cells)}"))
            cells.append((r, t))
    one = entries.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(r).alias("horizon"), F.lit(float(t)).alias("threshold"), F.col(f"h{i}").alias("hits"))
            for i, (r, t) in enumerate(cells)
        ]
    )
    out = one.select(*by, "entries", F.explode(rows).alias("_r")).select(*by, "entries", "_r.*")
    return out.withColumn("pct", F.col("hits") * 100.0 / F.col("entries"))


def compare_entries(
    df: DataFrame, variants: Mapping[str, Column], won: Column, ret="future_return", by: Sequence[str] = ()
) -> DataFrame:
    """Entries, success rate and mean return of each entry definition (strict, relaxed, ...)."""
    tags = F.array(*[F.when(c, F.lit(n)) for n, c in variants.items()])
    tagged = df.withColumn("_won", F.coalesce(won, F.lit(False)).cast("double"))
    tagged = tagged.withColumn("variant", F.explode(F.filter(tags, lambda t: t.isNotNull())))
    return tagged.groupBy(*by, "variant").agg(
        F.count(F.lit(1)).alias("entries"),
        (F.avg("_won") * 100).alias("success_rate"),
        (F.avg(ret) * 100).alias("avg_return_pct"),
    )
