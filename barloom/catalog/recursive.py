"""Exponential-smoothing queries, checked against recursive CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import bars, bars_sql, query
from barloom.catalog.cleaning import GRID_CTES, gappy
from barloom.catalog.windows import TR, case, lag
from barloom.operators import recursive as re_
from barloom.operators import windows as wi
from barloom.plans.series import columns_step, over_series

W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
BASE = f"{bars_sql()}, n AS (SELECT *, row_number() OVER w AS rn FROM bars {W})"
RBARS = "WITH RECURSIVE " + BASE


def recur(name: str, src: str, outs: dict[str, tuple[str, float]], lead: int = 0) -> str:
    """CTE with ``y = a*x + (1-a)*y_prev`` for each output, seeded at row lead+1."""
    first = ", ".join(f"{x} AS {o}" for o, (x, _) in outs.items())
    step = ", ".join(
        f"{a!r} * s.{x} + (1 - {a!r}) * r.{o} AS {o}" for o, (x, a) in outs.items()
    )
    return f"""{name} AS (
  SELECT symbol, rn, {first} FROM {src} WHERE rn = {lead + 1}
  UNION ALL SELECT s.symbol, s.rn, {step} FROM {name} r
  JOIN {src} s ON s.symbol = r.symbol AND s.rn = r.rn + 1)"""


def a(n):
    return 2.0 / (n + 1)


PERIODS = (8, 9, 21, 50, 200)


@query(
    "r1_ema",
    "symbol ts " + " ".join(f"ema_{n}:d" for n in PERIODS),
    RBARS
    + ", "
    + recur("e", "n", {f"ema_{n}": ("close", a(n)) for n in PERIODS})
    + " SELECT n.symbol, n.ts, e.* EXCLUDE (symbol, rn) FROM n JOIN e USING (symbol, rn)",
)
def r1(spark, sf):
    return over_series(bars(spark, sf), re_.ema("close", PERIODS))


@query(
    "r1_ema_sma_seed",
    "symbol ts ema_8:d ema_30:d",
    RBARS
    + f""", s AS (SELECT *, CASE WHEN rn = 8 THEN avg(close) OVER (w ROWS 7 PRECEDING) ELSE close END AS x8,
  CASE WHEN rn = 30 THEN avg(close) OVER (w ROWS 29 PRECEDING) ELSE close END AS x30 FROM n {W}), """
    + recur("e8", "s", {"ema_8": ("x8", a(8))}, 7)
    + ", "
    + recur("e30", "s", {"ema_30": ("x30", a(30))}, 29)
    + """ SELECT n.symbol, n.ts, ema_8, ema_30 FROM n LEFT JOIN e8 USING (symbol, rn)
  LEFT JOIN e30 USING (symbol, rn)""",
)
def r1s(spark, sf):
    return over_series(bars(spark, sf), re_.ema("close", (8, 30), seed="sma"))


def recur_adjusted(name, src, outs):
    """Numerators and denominators of weighted means."""
    first = ", ".join(f"CAST({x} AS DOUBLE) AS num_{o}, CAST(1.0 AS DOUBLE) AS den_{o}" for o, (x, _) in outs.items())
    step = ", ".join(
        f"s.{x} + (1 - {al!r}) * r.num_{o}, 1 + (1 - {al!r}) * r.den_{o}" for o, (x, al) in outs.items()
    )
    return f"""{name} AS (SELECT symbol, rn, {first} FROM {src} WHERE rn = 1
  UNION ALL SELECT s.symbol, s.rn, {step} FROM {name} r
  JOIN {src} s ON s.symbol = r.symbol AND s.rn = r.rn + 1)"""


@query(
    "r2_ema_adjusted",
    "symbol ts ema_12:d ema_26:d",
    RBARS
    + ", "
    + recur_adjusted("e", "n", {"a": ("close", a(12)), "b": ("close", a(26))})
    + """ SELECT n.symbol, n.ts, num_a / den_a AS ema_12, num_b / den_b AS ema_26
  FROM n JOIN e USING (symbol, rn)""",
)
def r2(spark, sf):
    return over_series(bars(spark, sf), re_.ema("close", (12, 26), adjusted=True))


# Half-hour bars on a full time grid: missing bars are nulls, at the head too where the first is cut.
GAPPY = f"""WITH RECURSIVE {GRID_CTES}, n AS (SELECT symbol, ts, CASE WHEN rn > 2 THEN close END AS close, rn
  FROM (SELECT *, row_number() OVER w AS rn FROM gappy {W}))"""



def gappy_bars(spark, sf):
    late = columns_step(lambda f: {"close": F.when(f.rn > 2, F.col("close"))})
    return over_series(gappy(spark, sf).select("symbol", "ts", "close"), late)


def recur_known(name: str, src: str, outs: dict[str, tuple[str, float, bool]]) -> str:
    """Weighted sums ``num`` and ``den`` over known values; the first one weighs 1, later ones alpha
    (adjusted: 1)."""
    first = ", ".join(
        f"CAST(coalesce({x}, 0) AS DOUBLE) AS num_{o}, CASE WHEN {x} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS den_{o}"
        for o, (x, _, _) in outs.items()
    )

    def step(o, x, al, adjusted):
        w = "1.0" if adjusted else f"CASE WHEN r.den_{o} = 0 THEN 1.0 ELSE {al!r} END"
        return (
            f"{1 - al!r} * r.num_{o} + CASE WHEN s.{x} IS NULL THEN 0 ELSE ({w}) * s.{x} END, "
            f"{1 - al!r} * r.den_{o} + CASE WHEN s.{x} IS NULL THEN 0 ELSE ({w}) END"
        )

    return f"""{name} AS (SELECT symbol, rn, {first} FROM {src} WHERE rn = 1
  UNION ALL SELECT s.symbol, s.rn, {", ".join(step(o, *v) for o, v in outs.items())} FROM {name} r
  JOIN {src} s ON s.symbol = r.symbol AND s.rn = r.rn + 1)"""


@query(
    "r1_ema_gappy",
    "symbol ts ema_2:d ema_3:d ema_9:d ema_50:d",
    GAPPY
    + ", "
    + recur_known("e", "n", {f"e{n}": ("close", a(n), False) for n in (2, 3, 9, 50)})
    + " SELECT n.symbol, n.ts, "
    + ", ".join(f"num_e{n} / nullif(den_e{n}, 0) AS ema_{n}" for n in (2, 3, 9, 50))
    + " FROM n JOIN e USING (symbol, rn)",
)
def r1_gappy(spark, sf):
    return over_series(gappy_bars(spark, sf), re_.ema("close", (2, 3, 9, 50)))


@query(
    "r2_ema_adjusted_gappy",
    "symbol ts ema_12:d ema_26:d",
    GAPPY
    + ", "
    + recur_known("e", "n", {"a": ("close", a(12), True), "b": ("close", a(26), True)})
    + """ SELECT n.symbol, n.ts, num_a / nullif(den_a, 0) AS ema_12, num_b / nullif(den_b, 0) AS ema_26
  FROM n JOIN e USING (symbol, rn)""",
)
def r2_gappy(spark, sf):
    return over_series(gappy_bars(spark, sf), re_.ema("close", (12, 26), adjusted=True))


@query(
    "r5_rsi_gappy",
    "symbol ts rsi_14:d",
    GAPPY
    + f""", d AS (SELECT *, close - {lag('close')} AS diff FROM n {W}),
u AS (SELECT *, CASE WHEN diff IS NOT NULL THEN greatest(diff, 0) END AS up,
  CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0) END AS dn FROM d), """
    + recur_known("e", "u", {"g": ("up", 1 / 14, False), "l": ("dn", 1 / 14, False)})
    + """ SELECT n.symbol, n.ts, 100 * (num_g / den_g) / nullif(num_g / den_g + num_l / den_l, 0) AS rsi_14
  FROM (SELECT symbol, rn, num_g, nullif(den_g, 0) AS den_g, num_l, nullif(den_l, 0) AS den_l FROM e) e
  JOIN n USING (symbol, rn)""",
)
def r5_gappy(spark, sf):
    return over_series(gappy_bars(spark, sf), re_.rsi((14,)))


@query(
    "r3_wilder",
    "symbol ts close_rma_14:d",
    RBARS
    + ", "
    + recur("e", "n", {"close_rma_14": ("close", 1 / 14)})
    + " SELECT n.symbol, n.ts, close_rma_14 FROM n JOIN e USING (symbol, rn)",
)
def r3(spark, sf):
    return over_series(bars(spark, sf), re_.wilder("close", 14))


@query(
    "r4_macd",
    "symbol ts macd:d macd_signal:d macd_hist:d macd_bullish:i macd_bearish:i",
    RBARS
    + ", "
    + recur("e", "n", {"f": ("close", a(12)), "s": ("close", a(26))})
    + ", m AS (SELECT symbol, rn, f - s AS macd FROM e), "
    + recur("g", "m", {"sig": ("macd", a(9))})
    + f""" SELECT n.symbol, n.ts, macd, sig AS macd_signal, macd - sig AS macd_hist,
  {case('macd > sig')} AS macd_bullish, {case('macd < sig')} AS macd_bearish
  FROM n JOIN m USING (symbol, rn) JOIN g USING (symbol, rn)""",
)
def r4(spark, sf):
    return over_series(bars(spark, sf), re_.macd())


@query(
    "r4_macd_adjusted",
    "symbol ts macd:d macd_signal:d",
    RBARS
    + ", "
    + recur_adjusted("e", "n", {"f": ("close", a(12)), "s": ("close", a(26))})
    + ", m AS (SELECT symbol, rn, num_f / den_f - num_s / den_s AS macd FROM e), "
    + recur_adjusted("g", "m", {"sig": ("macd", a(9))})
    + """ SELECT n.symbol, n.ts, macd, num_sig / den_sig AS macd_signal
  FROM n JOIN m USING (symbol, rn) JOIN g USING (symbol, rn)""",
)
def r4a(spark, sf):
    return over_series(bars(spark, sf), re_.macd(adjusted=True))


@query(
    "r5_rsi",
    "symbol ts rsi_14:d rsi_21:d rsi_change:d rsi_momentum:d",
    RBARS
    + f""", d AS (SELECT *, greatest(close - {lag('close')}, 0) AS up,
  greatest({lag('close')} - close, 0) AS dn FROM n {W}), """
    + recur("e", "d", {"g14": ("up", 1 / 14), "l14": ("dn", 1 / 14), "g21": ("up", 1 / 21), "l21": ("dn", 1 / 21)}, 1)
    + f""", r AS (SELECT n.symbol, n.ts, 100 * g14 / nullif(g14 + l14, 0) AS rsi_14,
  100 * g21 / nullif(g21 + l21, 0) AS rsi_21 FROM n LEFT JOIN e USING (symbol, rn))
SELECT *, rsi_14 - {lag('rsi_14')} AS rsi_change, rsi_14 - {lag('rsi_14', 3)} AS rsi_momentum FROM r {W}""",
)
def r5(spark, sf):
    return over_series(bars(spark, sf), re_.rsi((14, 21)), re_.rsi_momentum())


@query(
    "r6_atr",
    "symbol ts atr:d atr_pct:d",
    RBARS
    + f", d AS (SELECT *, {TR} AS tr FROM n {W}), "
    + recur("e", "d", {"atr": ("tr", 1 / 14)}, 1)
    + """ SELECT n.symbol, n.ts, atr, atr / close * 100 AS atr_pct
  FROM n LEFT JOIN e USING (symbol, rn)""",
)
def r6(spark, sf):
    return over_series(bars(spark, sf), re_.atr())


@query(
    "r7_adx",
    "symbol ts adx:d plus_di:d minus_di:d adx_change:d",
    RBARS
    + f""", u AS (SELECT *, high - {lag('high')} AS up, {lag('low')} - low AS down, {TR} AS tr FROM n {W}),
d AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm,
  CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm FROM u), """
    + recur("e", "d", {"p": ("pdm", 1 / 14), "m": ("mdm", 1 / 14), "t": ("tr", 1 / 14)}, 1)
    + """, x AS (SELECT symbol, rn, 100 * p / nullif(t, 0) AS plus_di, 100 * m / nullif(t, 0) AS minus_di,
  coalesce(100 * abs(p - m) / nullif(p + m, 0), 0) AS dx FROM e), """
    + recur("z", "x", {"adx": ("dx", 1 / 14)}, 1)
    + f""", o AS (SELECT n.symbol, n.ts, adx, plus_di, minus_di FROM n LEFT JOIN x USING (symbol, rn)
  LEFT JOIN z USING (symbol, rn))
SELECT *, adx - {lag('adx')} AS adx_change FROM o {W}""",
)
def r7(spark, sf):
    return over_series(bars(spark, sf), re_.adx())


@query(
    "r8_distance",
    "symbol ts dist:d dist_pct:d price_above_ema_21:i price_below_ema_21:i",
    RBARS
    + ", "
    + recur("e", "n", {"y": ("close", a(21))})
    + f""" SELECT n.symbol, n.ts, close - y AS dist, (close - y) / y * 100 AS dist_pct,
  {case('close > y')} AS price_above_ema_21, {case('close < y')} AS price_below_ema_21
  FROM n JOIN e USING (symbol, rn)""",
)
def r8(spark, sf):
    return over_series(bars(spark, sf), re_.ema("close", (21,)), re_.distance("ema_21"))


@query(
    "r9_ordering",
    "symbol ts ema_9_above_ema_21:i ema_21_above_ema_50:i ema_50_above_ema_200:i",
    RBARS
    + ", "
    + recur("e", "n", {f"e{n}": ("close", a(n)) for n in (9, 21, 50, 200)})
    + f""" SELECT n.symbol, n.ts, {case('e9 > e21')} AS ema_9_above_ema_21,
  {case('e21 > e50')} AS ema_21_above_ema_50, {case('e50 > e200')} AS ema_50_above_ema_200
  FROM n JOIN e USING (symbol, rn)""",
)
def r9(spark, sf):
    return over_series(
        bars(spark, sf),
        re_.ema("close", (9, 21, 50, 200)),
        re_.ordering("ema_9", "ema_21", "ema_50", "ema_200"),
    )
