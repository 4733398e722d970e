"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from barloom.catalog.base import bars, day_bars, table, ticks
from barloom.functions import scalars as sc
from barloom.operators import cleaning as cl
from barloom.operators import labels as la
from barloom.operators import metrics as mt
from barloom.operators import recursive as re_
from barloom.operators import trades as tr
from barloom.operators import validation as va
from barloom.operators import windows as wi
from barloom.plans.series import over_series
from barloom.session import build_session
from barloom.sources.ticks import ticks_to_bars


def feature_steps():
    """About sixty features in one layout: averages, oscillators, volatility, volume, traps."""
    return [
        wi.sma("close", (10, 20, 50)),
        re_.ema("close", (12, 21, 26, 50)),
        re_.macd(),
        re_.rsi((14, 21)),
        re_.atr(),
        re_.adx(),
        re_.distance("ema_21"),
        wi.bollinger(),
        wi.stochastic(smooth_k=3),
        wi.williams_r(),
        wi.volatility((5, 10, 20)),
        wi.volume_features(),
        wi.changes("close", (1, 2, 3, 5), "chg"),
        wi.cross_flags("close", "ema_21", back=re_.ema_back(21)),
        wi.event_counts(("cross_above", "cross_below"), (2, 3, 5, 10), back=re_.ema_back(21) + 1),
        wi.trap_flags(back=re_.ema_back(21) + 1),
        wi.swings(),
        wi.recent_range(),
    ]


def features(df):
    out = over_series(df, *feature_steps())
    return out.withColumns({**sc.candle_columns(), **sc.time_columns()})


def line_bars(spark, sf):
    """A large series: every lineitem row as a bar, three symbols, unique times."""
    li = table(spark, sf, "lineitem")
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.groupBy(F.col("l_returnflag").alias("symbol"), F.timestamp_seconds(at * 60).alias("ts")).agg(
        F.min("l_extendedprice").alias("open"),
        F.max("l_extendedprice").alias("high"),
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def sweep(spark, sf):
    from barloom.catalog.trades import signal_bars

    grid = tr.parameter_grid(
        spark,
        stop_atr=[1.0, 1.5, 2.0],
        target_atr=[1.5, 2.0, 2.5, 3.0],
        breakeven_rr=[0.5, 1.0, 1.5],
        trail_start_rr=[1.0, 1.5, 2.0],
        trail_atr=[0.5, 1.0, 1.5],
        min_volume=[2.0, 20.0],
    )
    names = ("stop_atr", "target_atr", "breakeven_rr", "trail_start_rr", "trail_atr")
    rule = tr.trailing_rule(*[F.col(n) for n in names], max_hold=15)
    on = F.col("signal") == 1
    return tr.sweep(
        signal_bars(spark, sf), grid, rule, on & (F.col("volume") >= F.col("min_volume")), candidate=on, entry_params=("min_volume",)
    )


QUERIES = {
    "ticks_to_bars": lambda s, d: bars(s, d),
    "forward_fill": lambda s, d: cl.forward_fill(bars(s, d, "30 minutes")),
    "fill_time_gaps": lambda s, d: cl.fill_time_gaps(bars(s, d, "10 minutes"), 600_000_000, 6),
    "quality_report": lambda s, d: va.quality_report(day_bars(s, d)),
    "features": lambda s, d: features(bars(s, d)),
    "features_day_bars": lambda s, d: features(day_bars(s, d)),
    "features_large": lambda s, d: features(line_bars(s, d)),
    "ema_large": lambda s, d: over_series(line_bars(s, d), re_.ema("close", (8, 21, 50, 200))),
    "obv_large": lambda s, d: wi.on_balance_volume(line_bars(s, d)),
    "swing_targets": lambda s, d: over_series(day_bars(s, d), la.swing_targets()),
    "backtest": lambda s, d: tr.backtest(
        over_series(day_bars(s, d), wi.atr_sma()).withColumn("signal", sc.green()).na.drop(subset=["atr"]),
        tr.trailing_rule(1.5, 2.0),
    ),
    "sweep_648": sweep,
    "roc_auc": lambda s, d: mt.roc_auc(
        ticks(s, d).select((F.col("value") > 50).cast("int").alias("label"), (F.col("ingest_id") % 997 / 997).alias("probability"))
    ),
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    bars(spark, sf).write.format("noop").mode("overwrite").save()
    only = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else list(QUERIES)
    times = {}
    for name in only:
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf.rstrip("/").split("sf")[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
