"""Cleaning and repair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, bars, bars_sql, query, ticks
from barloom.operators import cleaning as cl

HALF_HOUR = 1_800_000_000
COLS = "symbol ts open:d high:d low:d close:d volume:d"
PX = ("open", "high", "low", "close")

# Half-hour bars on a full grid: steps without events carry nulls.
GRID_CTES = f"""{bars_sql('30 minutes')},
ends AS (SELECT symbol, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM bars GROUP BY 1),
grid AS (SELECT symbol, unnest(generate_series(t0, t1, INTERVAL '30 minutes')) AS ts FROM ends),
gappy AS (SELECT g.symbol, g.ts, b.open, b.high, b.low, b.close, b.volume
          FROM grid g LEFT JOIN bars b ON b.symbol = g.symbol AND b.ts = g.ts)"""
GAPPY = "WITH " + GRID_CTES


def gappy(spark, sf):
    b = bars(spark, sf, "30 minutes")
    return cl.grid_join(b, HALF_HOUR).select("symbol", "ts", *PX, "volume")


def bars_with_repeats(spark, sf):
    """Ticks as one-price bars stamped by the hour: many rows per (symbol, ts)."""
    t = ticks(spark, sf)
    return t.select(
        "symbol",
        F.date_trunc("hour", "ts").cast(t.schema["ts"].dataType).alias("ts"),
        *[F.col("value").alias(c) for c in PX],
        F.when(F.col("value") < 60, F.col("value")).alias("volume"),
        "ingest_id",
    )


REPEATS_CTE = """rep AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, value AS open,
  value AS high, value AS low, value AS close, CASE WHEN value < 60 THEN value END AS volume,
  event_id AS ingest_id FROM events)"""


@query("j1_grid_join", COLS, GAPPY + "SELECT * FROM gappy")
def j1(spark, sf):
    return gappy(spark, sf)


@query(
    "c1_clean_data",
    COLS,
    f"""WITH {REPEATS_CTE}
SELECT symbol, ts, open, high, low, close, coalesce(volume, 0) AS volume FROM rep
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest_id) = 1""",
)
def c1(spark, sf):
    return cl.clean_data(bars_with_repeats(spark, sf), ingest="ingest_id")


@query(
    "c2_drop_missing",
    COLS,
    GAPPY + "SELECT symbol, ts, open, high, low, close, coalesce(volume, 0) AS volume FROM gappy "
    "WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL",
)
def c2(spark, sf):
    return cl.fill_missing(gappy(spark, sf), "drop")


def _ffill(c):
    return f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _bfill(c):
    return (
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts "
        "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )


@query(
    "c3_forward_fill",
    COLS,
    GAPPY
    + f""", f AS (SELECT symbol, ts, {', '.join(f'{_ffill(c)} AS {c}' for c in PX)},
  coalesce({_ffill('volume')}, 0) AS volume FROM gappy)
SELECT * FROM f WHERE open IS NOT NULL""",
)
def c3(spark, sf):
    return cl.fill_missing(gappy(spark, sf), "forward")


@query(
    "c4_backward_fill",
    COLS,
    GAPPY
    + f""", f AS (SELECT symbol, ts, {', '.join(f'{_bfill(c)} AS {c}' for c in PX)},
  coalesce({_ffill('volume')}, 0) AS volume FROM gappy)
SELECT * FROM f WHERE open IS NOT NULL""",
)
def c4(spark, sf):
    return cl.fill_missing(gappy(spark, sf), "backward")


def _lerp_sql(c):
    return f"""coalesce({c}, pv_{c} + (nv_{c} - pv_{c}) * (rn - pr) / (nr - pr), pv_{c}) AS {c}"""


@query(
    "c5_interpolate",
    COLS,
    GAPPY
    + f""", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM gappy),
m AS (SELECT *, CASE WHEN close IS NOT NULL THEN rn END AS known FROM n),
p AS (SELECT *, {_ffill('known')} AS pr, {_bfill('known')} AS nr,
  {', '.join(f'{_ffill(c)} AS pv_{c}, {_bfill(c)} AS nv_{c}' for c in PX)},
  {_ffill('volume')} AS pv_volume FROM m)
SELECT symbol, ts, {', '.join(_lerp_sql(c) for c in PX)}, coalesce(volume, pv_volume, 0) AS volume
FROM p WHERE pr IS NOT NULL""",
)
def c5(spark, sf):
    return cl.fill_missing(gappy(spark, sf), "interpolate")


@query(
    "c6_keep_first",
    "symbol ts close:d ingest_id:i",
    f"""WITH {REPEATS_CTE} SELECT symbol, ts, close, ingest_id FROM rep
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest_id) = 1""",
)
def c6(spark, sf):
    return cl.keep_first(bars_with_repeats(spark, sf), ingest="ingest_id")


LIMIT = 2


def _gap_sql(c):
    return f"""CASE WHEN {c} IS NOT NULL OR NOT fill THEN {c}
  WHEN g - pg <= {LIMIT} THEN pv_{c}
  WHEN g - pg <= {2 * LIMIT} THEN coalesce(pv_{c} + (nv_{c} - pv_{c}) * (g - pg - {LIMIT}) / (ng - pg - {LIMIT}), pv_{c})
  END AS {c}"""


ALL = (*PX, "volume")


@query(
    "c7_fill_time_gaps",
    COLS,
    GAPPY
    + f""", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS g FROM gappy),
sized AS (SELECT n.*, count(*) OVER (PARTITION BY n.symbol) > ends.n AS fill
  FROM n JOIN ends USING (symbol)),
m AS (SELECT *, CASE WHEN close IS NOT NULL THEN g END AS known FROM sized),
p AS (SELECT *, {_ffill('known')} AS pg, {_bfill('known')} AS ng,
  {', '.join(f'{_ffill(c)} AS pv_{c}, {_bfill(c)} AS nv_{c}' for c in ALL)} FROM m),
q AS (SELECT symbol, ts, fill, {', '.join(_gap_sql(c) for c in ALL)} FROM p)
SELECT symbol, ts, {', '.join(ALL)} FROM q WHERE NOT fill OR close IS NOT NULL""",
)
def c7(spark, sf):
    return cl.fill_time_gaps(bars(spark, sf, "30 minutes"), HALF_HOUR, LIMIT)


QUART = "quart AS (SELECT symbol, " + ", ".join(
    f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in ALL
) + " FROM bars GROUP BY 1)"


def _iqr(c):
    return (
        f"({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}))"
    )


MARKS = " ".join(f"out_{c}" for c in ALL)


@query(
    "c8_mark_iqr",
    f"symbol ts {MARKS}",
    BARS + f", {QUART} SELECT symbol, ts, "
    + ", ".join(f"{_iqr(c)} AS out_{c}" for c in ALL)
    + " FROM bars JOIN quart USING (symbol)",
)
def c8(spark, sf):
    return cl.mark_iqr(bars(spark, sf))


def _z(c):
    return (
        f"(abs({c} - avg({c}) OVER (PARTITION BY symbol)) / stddev_pop({c}) OVER (PARTITION BY symbol) > 3.0)"
    )


@query(
    "c9_mark_zscore",
    f"symbol ts {MARKS}",
    BARS + "SELECT symbol, ts, " + ", ".join(f"{_z(c)} AS out_{c}" for c in ALL) + " FROM bars",
)
def c9(spark, sf):
    return cl.mark_zscore(bars(spark, sf))


@query(
    "c10_outlier_rows",
    COLS,
    BARS + "SELECT * FROM bars QUALIFY " + " OR ".join(_z(c) for c in ALL),
)
def c10(spark, sf):
    return cl.outlier_rows(bars(spark, sf))


@query(
    "c11_clamp_price_outliers",
    COLS,
    BARS
    + f""", {QUART},
med AS (SELECT symbol, {', '.join(f'median({c}) AS m_{c}' for c in PX)} FROM bars GROUP BY 1),
mad AS (SELECT symbol, {', '.join(f'median(abs({c} - m_{c})) AS d_{c}' for c in PX)}
        FROM bars JOIN med USING (symbol) GROUP BY 1)
SELECT symbol, ts, {', '.join(f'CASE WHEN {_iqr(c)} THEN least(greatest({c}, m_{c} - 5 * d_{c}), m_{c} + 5 * d_{c}) ELSE {c} END AS {c}' for c in PX)},
  volume FROM bars JOIN quart USING (symbol) JOIN med USING (symbol) JOIN mad USING (symbol)""",
)
def c11(spark, sf):
    return cl.clamp_price_outliers(bars(spark, sf))


@query(
    "c12_cap_volume_outliers",
    COLS,
    BARS
    + f""", {QUART}, p AS (SELECT symbol, quantile_cont(volume, 0.99) AS p99 FROM bars GROUP BY 1)
SELECT symbol, ts, open, high, low, close,
  CASE WHEN {_iqr('volume')} THEN least(volume, p99) ELSE volume END AS volume
FROM bars JOIN quart USING (symbol) JOIN p USING (symbol)""",
)
def c12(spark, sf):
    return cl.cap_volume_outliers(bars(spark, sf))


@query(
    "c13_repair_ohlc",
    COLS,
    BARS
    + """, bad AS (SELECT symbol, ts, open, low AS high, high AS low, close, volume FROM bars)
SELECT symbol, ts, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close,
  volume FROM bad""",
)
def c13(spark, sf):
    b = bars(spark, sf)
    return cl.repair_ohlc(b.withColumns({"high": F.col("low"), "low": F.col("high")}))


@query(
    "c14_repair_volume",
    COLS,
    BARS + "SELECT symbol, ts, open, high, low, close, abs(volume * sign(open - close)) AS volume FROM bars",
)
def c14(spark, sf):
    b = bars(spark, sf)
    return cl.repair_volume(b.withColumn("volume", F.col("volume") * F.signum(F.col("open") - F.col("close"))))


@query(
    "c15_cap_close_moves",
    "symbol ts close:d4",
    "WITH RECURSIVE "
    + bars_sql()
    + """, n AS (SELECT symbol, ts, close, row_number() OVER w AS rn,
  coalesce(abs(close / lag(close) OVER w - 1) > 0.2, false) AS hit
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
r AS (SELECT symbol, ts, rn, close FROM n WHERE rn = 1
  UNION ALL SELECT n.symbol, n.ts, n.rn,
    CASE WHEN n.hit THEN least(greatest(n.close, r.close - r.close * 0.2), r.close + r.close * 0.2)
    ELSE n.close END
  FROM r JOIN n ON n.symbol = r.symbol AND n.rn = r.rn + 1)
SELECT symbol, ts, close FROM r""",
)
def c15(spark, sf):
    return cl.cap_close_moves(bars(spark, sf), 0.2)


@query("c16_preprocess", COLS)
def c16(spark, sf):
    return cl.preprocess(bars(spark, sf, "30 minutes"), HALF_HOUR, LIMIT)
