"""Label queries, checked against range self-joins on row numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, W, bars, query
from barloom.catalog.windows import CROSS, TR, TRAP, case, chain_sql, cross_steps, feature, lag, pct, rolled
from barloom.functions import scalars as sc
from barloom.operators import labels as la
from barloom.operators import windows as wi
from barloom.plans.series import columns_step, over_series


def lead(col: str, n: int = 1) -> str:
    return f"lead({col}, {n}) OVER w"


def fwd(k: int) -> str:
    return f"({lead('close', k)} / close - 1)"


feature(
    "l1_next_period",
    "future_return:d target:i target_binary:i",
    lambda: [la.next_period(2, 0.2, -0.2)],
    {"future_return": fwd(2)},
    {"target": "CASE WHEN future_return <= -0.2 THEN -1 WHEN future_return >= 0.2 THEN 1 ELSE 0 END"},
    {"target_binary": case("target = 1")},
)

K = 5
feature(
    "l2_fixed_horizon",
    "future_max_return:d future_min_return:d target:i target_binary:i",
    lambda: [la.fixed_horizon(K, 2.0, -0.9)],
    {"sh": lead("high", K), "sl": lead("low", K)},
    {
        "future_max_return": f"max(sh) OVER (w ROWS {K - 1} PRECEDING) / close - 1",
        "future_min_return": f"min(sl) OVER (w ROWS {K - 1} PRECEDING) / close - 1",
    },
    {
        "hit": "coalesce(future_max_return >= 2.0, false)",
        "bad": "coalesce(future_min_return <= -0.9, false)",
    },
    {
        "target": "CASE WHEN hit AND bad THEN CASE WHEN abs(future_max_return) > abs(future_min_return) THEN 1 "
        "WHEN abs(future_min_return) > abs(future_max_return) THEN -1 ELSE 0 END "
        "WHEN hit THEN 1 WHEN bad THEN -1 ELSE 0 END"
    },
    {"target_binary": case("target = 1")},
)

_ENTRY = {
    "ok": "hour(ts) BETWEEN 6 AND 20 AND (high - low) / high * 60 BETWEEN 15 AND 59",
}


def entry_steps(lookback=10, candle=400.0):
    conditions = columns_step(
        lambda f: {
            "in_entry_window": sc.within("ts", (360, 1259)),
            "adx_in_range": sc.flag(
                ((F.col("high") - F.col("low")) / F.col("high") * 60).between(15, 59)
            ),
            "small_candle": sc.small_candle(candle),
        }
    )
    return [*cross_steps(), wi.trap_flags(back=20, lookback=lookback), conditions]


def entry_sql(lookback, k, thr, candle=400.0):
    trap = {n: e.replace("10 PRECEDING", f"{lookback} PRECEDING") for n, e in TRAP.items()}
    return (
        *CROSS,
        {**trap, **_ENTRY, "small": f"abs(close - open) / open * 100 <= {candle}", "r": fwd(k)},
        {
            "bearish_entry": case("bearish_trap = 1 AND ok AND small"),
            "bullish_entry": case("bullish_trap = 1 AND ok AND small"),
        },
        {
            "target": f"CASE WHEN bullish_entry = 1 AND r >= {thr} THEN 1 "
            f"WHEN bearish_entry = 1 AND r <= -{thr} THEN -1 ELSE 0 END",
        },
        {"target_binary": case("target <> 0")},
    )


feature(
    "l3_trap_entry",
    "bearish_entry:i bullish_entry:i target:i target_binary:i",
    lambda: [*entry_steps(), la.trap_entry(2, 0.2, -0.2)],
    *entry_sql(10, 2, 0.2),
)
feature(
    "l5_relaxed_entry",
    "bearish_entry:i bullish_entry:i target_binary:i",
    lambda: [*entry_steps(lookback=3, candle=900.0), la.trap_entry(2, 0.1, -0.1)],
    *entry_sql(3, 2, 0.1, 900.0),
)
feature(
    "l6_any_horizon",
    "target:i",
    lambda: [
        *cross_steps(),
        la.any_horizon((1, 2, 3), 0.3, bear="cross_below", bull="cross_above"),
    ],
    *CROSS,
    {f"r{k}": fwd(k) for k in (1, 2, 3)},
    {
        "target": case(
            "cross_below = 1 AND (r1 <= -0.3 OR r2 <= -0.3 OR r3 <= -0.3) "
            "OR cross_above = 1 AND (r1 >= 0.3 OR r2 >= 0.3 OR r3 >= 0.3)"
        )
    },
)


@query(
    "l4_movement",
    "symbol ts future_max_return:d future_min_return:d target:i direction:i",
    BARS
    + chain_sql(
        {"sh": lead("high", 2), "sl": lead("low", 2), "fr": fwd(2)},
        {
            "future_max_return": f"({rolled('max', 'sh', 2)}) / close - 1",
            "future_min_return": f"({rolled('min', 'sl', 2)}) / close - 1",
        },
        {
            "u": case("future_max_return >= 3.0"),
            "d": case("future_min_return <= -0.8"),
        },
        {"target": "greatest(u, d)", "direction": "u - d"},
    )
    + " WHERE fr IS NOT NULL",
)
def l4(spark, sf):
    # Sized for these prices: a rise of 300% or a fall of 80%.
    from barloom.plans.series import Step

    base = la.movement(2, 3.0)
    fall = Step(
        lambda df, f: df.withColumns(
            {
                "_u": sc.flag(F.col("future_max_return") >= 3.0),
                "_d": sc.flag(F.col("future_min_return") <= -0.8),
            }
        ).withColumns({"target": F.greatest("_u", "_d"), "direction": F.col("_u") - F.col("_d")})
    )
    return over_series(bars(spark, sf), base, fall)


@query(
    "l4_movement_symmetric",
    "symbol ts target:i direction:i",
    BARS
    + chain_sql(
        {"sh": lead("high", 2), "sl": lead("low", 2), "fr": fwd(2)},
        {"u": case(f"({rolled('max', 'sh', 2)}) / close - 1 >= 0.6"),
         "d": case(f"({rolled('min', 'sl', 2)}) / close - 1 <= -0.6")},
        {"target": "greatest(u, d)", "direction": "u - d"},
    )
    + " WHERE fr IS NOT NULL",
)
def l4b(spark, sf):
    return over_series(bars(spark, sf), la.movement(2, 0.6))


_FAM = [(k, t) for k in (1, 3, 5) for t in (0.2, 0.5)]
feature(
    "l7_threshold_family",
    " ".join(f"up_{round(t * 10000)}bp_{k}:i down_{round(t * 10000)}bp_{k}:i move_{round(t * 10000)}bp_{k}:i" for k, t in _FAM),
    lambda: [la.threshold_family((1, 3, 5), (0.2, 0.5))],
    {f"r{k}": fwd(k) for k in (1, 3, 5)},
    {
        n: e
        for k, t in _FAM
        for n, e in {
            f"up_{round(t * 10000)}bp_{k}": case(f"r{k} > {t}"),
            f"down_{round(t * 10000)}bp_{k}": case(f"r{k} < -{t}"),
            f"move_{round(t * 10000)}bp_{k}": case(f"abs(r{k}) > {t}"),
        }.items()
    },
)
feature(
    "l8_high_volatility",
    "recent_volatility:d next_volatility:d target_high_volatility:i",
    lambda: [la.high_volatility()],
    {"ret": pct("close")},
    {"sr": lead("ret", 3)},
    {
        "recent_volatility": rolled("stddev_samp", "ret", 20),
        "next_volatility": rolled("stddev_samp", "sr", 3),
    },
    {"target_high_volatility": case("next_volatility > recent_volatility * 1.5")},
)
feature(
    "l9_trend_continuation",
    "target_trend:i",
    lambda: [
        *cross_steps(),
        wi.spread_features("sma_5", "sma_20", back=19),
        la.trend_continuation(),
    ],
    *CROSS,
    {"spread": "(sma_5 - sma_20) / close"},
    {"target_trend": case(f"sign(spread) = sign({lead('spread', 5)})")},
)
feature(
    "l10_valid_crossover",
    "target_valid_cross:i",
    lambda: [
        *cross_steps(),
        wi.spread_features("sma_5", "sma_20", back=19),
        la.valid_crossover(),
    ],
    *CROSS,
    {"spread": "(sma_5 - sma_20) / close", "rn": "row_number() OVER w"},
    {"nxt": "avg(spread) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)", "tail": lead("rn", 5)},
    {
        "target_valid_cross": case(
            "rn > 5 AND tail IS NOT NULL AND (cross_above = 1 AND nxt > spread OR cross_below = 1 AND nxt < spread)"
        )
    },
)

NUMBERED = f", n0 AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS cnt, {TR} AS tr FROM bars {W})"


@query(
    "l11_triple_barrier",
    "symbol ts target_binary:i",
    BARS
    + NUMBERED
    + f""", n AS (SELECT *, {rolled('avg', 'tr', 14)} AS atr FROM n0 {W}),
h AS (SELECT a.symbol, a.rn, min(b.rn) FILTER (b.high >= a.close + a.atr * 2) AS up,
  min(b.rn) FILTER (b.low <= a.close - a.atr) AS dn
  FROM n a JOIN n b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 8 GROUP BY 1, 2)
SELECT n.symbol, n.ts, {case('up IS NOT NULL AND (dn IS NULL OR up <= dn)')} AS target_binary
FROM n LEFT JOIN h USING (symbol, rn) WHERE rn <= cnt - 8""",
)
def l11(spark, sf):
    return over_series(bars(spark, sf), wi.atr_sma(14), la.triple_barrier(8, 2.0, 1.0))


@query(
    "l11_triple_barrier_far",
    "symbol ts target_binary:i",
    BARS
    + NUMBERED
    + f""", n AS (SELECT *, {rolled('avg', 'tr', 14)} AS atr FROM n0 {W}),
h AS (SELECT a.symbol, a.rn, min(b.rn) FILTER (b.high >= a.close + a.atr * 6) AS up,
  min(b.rn) FILTER (b.low <= a.close - a.atr * 1.5) AS dn
  FROM n a JOIN n b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 2000 GROUP BY 1, 2)
SELECT n.symbol, n.ts, {case('up IS NOT NULL AND (dn IS NULL OR up <= dn)')} AS target_binary
FROM n LEFT JOIN h USING (symbol, rn)""",
)
def l11_far(spark, sf):
    """A horizon of 2,000 bars."""
    rows = over_series(bars(spark, sf), wi.atr_sma(14))
    return la.triple_barrier_far(rows, 2000, 6.0, 1.5, keep_tail=True)


@query(
    "l12_swing_targets",
    "symbol ts target_long_1r:i target_short_1r:i target_long_2r:i target_short_2r:i",
    BARS
    + NUMBERED
    + f""", n AS (SELECT *, min(low) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS lo,
  max(high) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS hi FROM n0 {W}),
h AS (SELECT a.symbol, a.rn, min(b.rn) FILTER (b.low <= a.lo) AS ls, min(b.rn) FILTER (b.high >= a.hi) AS ss,
  min(b.rn) FILTER (b.high >= a.close + (a.close - a.lo)) AS l1,
  min(b.rn) FILTER (b.high >= a.close + (a.close - a.lo) * 2) AS l2,
  min(b.rn) FILTER (b.low <= a.close - (a.hi - a.close)) AS s1,
  min(b.rn) FILTER (b.low <= a.close - (a.hi - a.close) * 2) AS s2
  FROM n a JOIN n b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 20 GROUP BY 1, 2)
SELECT n.symbol, n.ts, """
    + ", ".join(
        f"{case(f'rn > 10 AND rn <= cnt - 20 AND {cond} AND {t} IS NOT NULL AND ({s} IS NULL OR {t} < {s})')} AS {name}"
        for name, t, s, cond in (
            ("target_long_1r", "l1", "ls", "close > lo"),
            ("target_short_1r", "s1", "ss", "hi > close"),
            ("target_long_2r", "l2", "ls", "close > lo"),
            ("target_short_2r", "s2", "ss", "hi > close"),
        )
    )
    + " FROM n LEFT JOIN h USING (symbol, rn)",
)
def l12(spark, sf):
    return over_series(bars(spark, sf), la.swing_targets())


L13_CTE = (
    NUMBERED
    + f""", n1 AS (SELECT *, avg(tr) OVER (w ROWS 13 PRECEDING) AS atr1 FROM n0 {W}),
n AS (SELECT *, {lag('atr1')} AS atr FROM n1 {W}),
h AS (SELECT a.symbol, a.rn,
  min(b.rn) FILTER (b.high >= a.close + a.atr * 1.5) AS u1, min(b.rn) FILTER (b.low <= a.close - a.atr * 1.5) AS d1,
  min(b.rn) FILTER (b.high >= a.close + a.atr * 3) AS u2, min(b.rn) FILTER (b.low <= a.close - a.atr * 3) AS d2
  FROM n a JOIN n b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn + 3 AND a.rn + 20 GROUP BY 1, 2)"""
)


def _l13(pairs):
    return ", ".join(
        f"{case(f'rn <= cnt - 20 AND atr <> 0 AND {t} IS NOT NULL AND ({s} IS NULL OR {t} <= {s})')} AS {name}"
        for name, t, s in pairs
    )


@query(
    "l13_atr_targets",
    "symbol ts target_long_1r:i target_short_1r:i target_long_2r:i target_short_2r:i",
    BARS
    + L13_CTE
    + "SELECT n.symbol, n.ts, "
    + _l13(
        (
            ("target_long_1r", "u1", "d1"),
            ("target_short_1r", "d1", "u1"),
            ("target_long_2r", "u2", "d2"),
            ("target_short_2r", "d2", "u2"),
        )
    )
    + " FROM n LEFT JOIN h USING (symbol, rn)",
)
def l13(spark, sf):
    return over_series(bars(spark, sf), la.atr_targets())


@query(
    "l13_atr_targets_with_stop",
    "symbol ts target_long_2r:i target_short_2r:i",
    BARS
    + L13_CTE
    + "SELECT n.symbol, n.ts, "
    + _l13((("target_long_2r", "u2", "d1"), ("target_short_2r", "d2", "u1")))
    + " FROM n LEFT JOIN h USING (symbol, rn)",
)
def l13s(spark, sf):
    return over_series(bars(spark, sf), la.atr_targets((2.0,), respect_stop=True))


@query(
    "l14_combined",
    "symbol ts target_combined_1r:i direction_1r:i",
    BARS
    + L13_CTE
    + ", t AS (SELECT n.symbol, n.ts, "
    + _l13((("l", "u1", "d1"), ("s", "d1", "u1")))
    + f""" FROM n LEFT JOIN h USING (symbol, rn))
SELECT symbol, ts, {case('l = 1 OR s = 1')} AS target_combined_1r,
  CASE WHEN s = 1 THEN -1 WHEN l = 1 THEN 1 ELSE 0 END AS direction_1r FROM t""",
)
def l14(spark, sf):
    return over_series(bars(spark, sf), la.atr_targets((1.0,))).withColumns(la.combined((1.0,)))


TARGET = chain_sql(
    {"r": fwd(1)}, {"target": "CASE WHEN r <= -0.2 THEN -1 WHEN r >= 0.2 THEN 1 ELSE 0 END"}
).replace(" SELECT * FROM g1", "")


def labelled(spark, sf):
    return over_series(bars(spark, sf), la.next_period(1, 0.2, -0.2))


@query(
    "l15_distribution",
    "symbol target:i n:i pct:d",
    BARS
    + TARGET
    + " SELECT symbol, target, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY symbol) AS pct "
    "FROM g1 GROUP BY 1, 2",
)
def l15(spark, sf):
    return la.distribution(labelled(spark, sf), by=["symbol"])


@query(
    "l16_validate",
    "symbol rows:i invalid:i classes:i rarest_share:d is_valid n_warnings:i",
    BARS
    + TARGET
    + """, c AS (SELECT symbol, target, count(*) AS n FROM g1 GROUP BY 1, 2)
SELECT symbol, sum(n) AS rows, 0 AS invalid, count(*) AS classes, min(n) / sum(n) AS rarest_share,
  true AS is_valid, (min(n) / sum(n) < 0.05)::INT + (sum(n) < 100)::INT AS n_warnings FROM c GROUP BY 1""",
)
def l16(spark, sf):
    v = la.validate(labelled(spark, sf), by=["symbol"])
    return v.withColumn("n_warnings", F.size("warnings"))


@query(
    "l17_leakage_audit",
    "symbol feature abs_corr:d future_name verdict",
    BARS
    + TARGET
    + ", l AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS feature, abs(corr({e}, target)) AS abs_corr FROM g1 GROUP BY 1"
        for c, e in (("close", "close"), ("volume", "volume"), ("future_sign", "sign(r)"))
    )
    + """) SELECT symbol, feature, abs_corr, feature = 'future_sign' AS future_name,
  CASE WHEN abs_corr > 0.95 THEN 'leak' WHEN abs_corr > 0.8 THEN 'suspicious' ELSE 'ok' END AS verdict FROM l""",
)
def l17(spark, sf):
    d = labelled(spark, sf).withColumn("future_sign", F.signum("future_return"))
    return la.leakage_audit(d, ["close", "volume", "future_sign"], by=["symbol"])


@query(
    "l17_class_ratio",
    "symbol positives:i negatives:i ratio:d",
    BARS
    + TARGET
    + """ SELECT symbol, count(*) FILTER (target = 1) AS positives, count(*) FILTER (target = 0) AS negatives,
  count(*) FILTER (target = 1) / count(*) FILTER (target = 0) AS ratio FROM g1 GROUP BY 1""",
)
def l17b(spark, sf):
    return la.class_ratio(labelled(spark, sf), by=["symbol"])
