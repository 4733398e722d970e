"""Signal and entry-filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, W, bars, query
from barloom.catalog.windows import case, chain_sql, rolled
from barloom.catalog.labels import fwd
from barloom.operators import signals as sg
from barloom.operators import windows as wi
from barloom.plans.series import columns_step, over_series

# Scored bars: the close's place in its range serves as probability.
SCORED = BARS + """, scored AS (SELECT *, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS probability,
  60 * (high - low) / high AS adx, volume / 3 AS volume_ratio, (high - low) / close AS volatility,
  hour(ts) * 60 + minute(ts) AS m FROM bars)"""


def scored(spark, sf):
    b = bars(spark, sf)
    span = F.col("high") - F.col("low")
    return b.withColumns(
        {
            "probability": F.when(span > 0, (F.col("close") - F.col("low")) / span).otherwise(0.5),
            "adx": span * 60 / F.col("high"),
            "volume_ratio": F.col("volume") / 3,
            "volatility": span / F.col("close"),
        }
    )


CONDS_SQL = {
    "prob": "probability >= 0.6",
    "adx": "adx >= 20",
    "window": "m BETWEEN 360 AND 1200",
    "not_late": "m < 1080",
    "volume": "volume_ratio >= 0.8",
    "candle": "close > open AND (close - open) / open * 100 >= 15 AND close >= (high + low) / 2",
}


def conds():
    return sg.entry_conditions(
        min_prob=0.6, min_adx=20, window=(360, 1200), not_from=1080, min_volume=0.8,
        strong_green=True, min_body=15,
    )


@query(
    "f1_entry_filters",
    "symbol ts signal:i range_20_pct:d",
    SCORED
    + chain_sql(
        {"range_20_pct": f"(({rolled('max', 'high', 20)}) - ({rolled('min', 'low', 20)})) / close * 100"},
        {"signal": case(" AND ".join(CONDS_SQL.values()) + " AND range_20_pct >= 200")},
        base="scored",
    ),
)
def f1(spark, sf):
    d = over_series(scored(spark, sf), wi.recent_range())
    return d.withColumn(
        "signal", sg.flag(sg.all_of({**conds(), **sg.entry_conditions(min_range=200)}))
    )


@query(
    "f1_market_hours",
    "symbol ts signal:i",
    BARS + "SELECT symbol, ts, CASE WHEN hour(ts) * 60 + minute(ts) BETWEEN 555 AND 915 "
    "AND hour(ts) * 60 + minute(ts) < 870 THEN 1 ELSE 0 END AS signal FROM bars",
)
def f1m(spark, sf):
    return bars(spark, sf).withColumn("signal", sg.flag(sg.all_of(sg.market_hours())))


_acc, _parts = [], []
for _i, (_n, _e) in enumerate(CONDS_SQL.items()):
    _acc.append(f"({_e})")
    _parts.append(
        f"SELECT symbol, {_i} AS step, '{_n}' AS condition, count(*) FILTER ({_e}) AS alone, "
        f"count(*) FILTER ({' AND '.join(_acc)}) AS passed, "
        f"count(*) FILTER ({' AND '.join(_acc)}) * 100.0 / count(*) AS pct FROM scored GROUP BY 1"
    )


@query(
    "f2_entry_funnel",
    "symbol step:i condition alone:i passed:i pct:d",
    SCORED + " UNION ALL ".join(_parts),
)
def f2(spark, sf):
    return sg.funnel(scored(spark, sf), conds(), ["symbol"])


RETURNS = {f"r{k}": fwd(k) for k in (1, 2, 5)}


def with_returns(spark, sf):
    step = columns_step(
        lambda f: {f"r{k}": f.lead("close", k) / F.col("close") - 1 for k in (1, 2, 5)}, ahead=5
    )
    return over_series(scored(spark, sf), step)


@query(
    "f3_profitability",
    "symbol horizon threshold:d entries:i hits:i pct:d",
    SCORED
    + f", e AS (SELECT * FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in RETURNS.items())} FROM scored {W}) WHERE close > open) "
    + " UNION ALL ".join(
        f"SELECT symbol, '{n}' AS horizon, {t} AS threshold, count(*) AS entries, "
        f"count(*) FILTER (abs({n}) >= {t}) AS hits, count(*) FILTER (abs({n}) >= {t}) * 100.0 / count(*) AS pct FROM e GROUP BY 1"
        for n in RETURNS
        for t in (0.1, 0.3, 0.5)
    ),
)
def f3(spark, sf):
    entries = with_returns(spark, sf).filter("close > open")
    return sg.profitability(entries, list(RETURNS), (0.1, 0.3, 0.5), ["symbol"])


@query(
    "f4_strict_vs_relaxed",
    "symbol variant entries:i success_rate:d avg_return_pct:d",
    SCORED
    + f", e AS (SELECT *, {RETURNS['r2']} AS r2 FROM scored {W}) "
    + " UNION ALL ".join(
        f"SELECT symbol, '{v}' AS variant, count(*) AS entries, "
        "avg(CASE WHEN coalesce(r2 >= 0.2, false) THEN 100.0 ELSE 0 END) AS success_rate, "
        f"avg(r2) * 100 AS avg_return_pct FROM e WHERE {c} GROUP BY 1"
        for v, c in (("strict", "probability >= 0.9"), ("relaxed", "probability >= 0.6"))
    ),
)
def f4(spark, sf):
    p = F.col("probability")
    return sg.compare_entries(
        with_returns(spark, sf), {"strict": p >= 0.9, "relaxed": p >= 0.6}, F.col("r2") >= 0.2, "r2", ["symbol"]
    )


RAW = "CASE WHEN probability >= 0.55 THEN 1 WHEN probability <= 0.45 THEN -1 ELSE 0 END"
CONF = "least(abs(probability - 0.5) * 2, 1.0)"


@query("f5_raw_signal", "symbol ts signal:i", SCORED + f"SELECT symbol, ts, {RAW} AS signal FROM scored")
def f5(spark, sf):
    return scored(spark, sf).withColumn("signal", sg.raw_signal())


@query(
    "f6_confidence",
    "symbol ts confidence:d signal:i",
    SCORED
    + f"SELECT symbol, ts, {CONF} AS confidence, CASE WHEN {CONF} < 0.6 THEN 0 ELSE {RAW} END AS signal FROM scored",
)
def f6(spark, sf):
    return scored(spark, sf).withColumns(
        {"confidence": sg.confidence(), "signal": sg.confident_signal()}
    )


@query(
    "f7_regime_filter",
    "symbol ts signal:i",
    SCORED + f"SELECT symbol, ts, CASE WHEN volatility > 1.5 THEN 0 ELSE {RAW} END AS signal FROM scored",
)
def f7(spark, sf):
    d = scored(spark, sf).withColumn("signal", sg.raw_signal())
    return sg.regime_filter(d, threshold=1.5)


SMOOTH = SCORED + chain_sql(
    {"signal": RAW},
    {"total": "sum(signal) OVER (w ROWS 2 PRECEDING)", "have": "count(signal) OVER (w ROWS 2 PRECEDING)"},
    {"smoothed": "CASE WHEN have < 3 THEN signal WHEN total > 3 * 0.3 THEN 1 WHEN total < -3 * 0.3 THEN -1 ELSE 0 END"},
    base="scored",
)


def smoothed(spark, sf):
    d = scored(spark, sf).withColumn("signal", sg.raw_signal())
    return over_series(d, sg.smoothed_signal())


@query("f8_smoothed_signal", "symbol ts signal:i smoothed:i", SMOOTH)
def f8(spark, sf):
    return smoothed(spark, sf)


@query(
    "f9_signal_statistics",
    "symbol total_signals:i buy_signals:i sell_signals:i hold_signals:i buy_percentage:d sell_percentage:d hold_percentage:d",
    SCORED
    + f""", s AS (SELECT symbol, {RAW} AS g FROM scored)
SELECT symbol, count(*) AS total_signals, count(*) FILTER (g = 1) AS buy_signals,
  count(*) FILTER (g = -1) AS sell_signals, count(*) FILTER (g = 0) AS hold_signals,
  count(*) FILTER (g = 1) * 100.0 / count(*) AS buy_percentage,
  count(*) FILTER (g = -1) * 100.0 / count(*) AS sell_percentage,
  count(*) FILTER (g = 0) * 100.0 / count(*) AS hold_percentage FROM s GROUP BY 1""",
)
def f9(spark, sf):
    d = scored(spark, sf).withColumn("signal", sg.raw_signal())
    return sg.signal_statistics(d, by=["symbol"])


@query(
    "f9_recent_signals",
    "symbol recent",
    SCORED
    + f""", s AS (SELECT symbol, ts, {RAW} AS g, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS i FROM scored)
SELECT symbol, string_agg(CAST(g AS VARCHAR), ',' ORDER BY ts) AS recent FROM s WHERE i <= 10 GROUP BY 1""",
)
def f9b(spark, sf):
    d = scored(spark, sf).withColumn("signal", sg.raw_signal())
    r = sg.recent_signals(d)
    return r.withColumn("recent", F.array_join(F.col("recent_signals").cast("array<string>"), ","))


@query(
    "f10_latest_row",
    "symbol ts open:d high:d low:d close:d volume:d",
    BARS + "SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
)
def f10(spark, sf):
    return sg.latest_row(bars(spark, sf))


@query(
    "f12_vote_ensemble",
    "symbol ts soft:d hard:i",
    SCORED
    + f"""SELECT symbol, ts, (probability + 1 - adx / 60) / 2 AS soft,
  {case('(probability >= 0.5)::INT + (1 - adx / 60 >= 0.5)::INT >= 1')} AS hard FROM scored""",
)
def f12(spark, sf):
    d = scored(spark, sf).withColumn("p2", F.lit(1.0) - F.col("adx") / 60)
    d = d.withColumns({"y1": sg.flag(F.col("probability") >= 0.5), "y2": sg.flag(F.col("p2") >= 0.5)})
    return d.withColumns({"soft": sg.soft_vote(["probability", "p2"]), "hard": sg.hard_vote(["y1", "y2"])})
