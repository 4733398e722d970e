"""Validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, W, bars, bars_sql, query, ticks
from barloom.catalog.cleaning import GAPPY, GRID_CTES, REPEATS_CTE, bars_with_repeats, gappy
from barloom.operators import validation as va

ALL = ("open", "high", "low", "close", "volume")
PX = ALL[:4]

# Bars with high and low swapped on falling bars and volume signed by direction.
BROKEN_CTE = f"""{bars_sql()}, broken AS (SELECT symbol, ts, open,
  CASE WHEN close < open THEN low ELSE high END AS high,
  CASE WHEN close < open THEN high ELSE low END AS low,
  close - 5 AS close, volume * sign(close - open) AS volume FROM bars)"""


def broken(spark, sf):
    b = bars(spark, sf)
    down = F.col("close") < F.col("open")
    return b.select(
        "symbol",
        "ts",
        "open",
        F.when(down, F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(down, F.col("high")).otherwise(F.col("low")).alias("low"),
        (F.col("close") - 5).alias("close"),
        (F.col("volume") * F.signum(F.col("close") - F.col("open"))).alias("volume"),
    )


@query(
    "v1_completeness",
    "symbol rows:i is_complete " + " ".join(f"missing_{c}:d" for c in ALL),
    GAPPY
    + ", a AS (SELECT symbol, count(*) AS rows, "
    + ", ".join(f"(count(*) - count({c})) / count(*) AS missing_{c}" for c in ALL)
    + " FROM gappy GROUP BY 1) SELECT *, rows >= 100 AND greatest("
    + ", ".join(f"missing_{c}" for c in ALL)
    + ") <= 0.05 AS is_complete FROM a",
)
def v1(spark, sf):
    return va.completeness(gappy(spark, sf))


@query(
    "v2_missing_profile",
    "symbol column missing:i missing_pct:d severity",
    GAPPY
    + ", a AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS missing FROM gappy GROUP BY 1"
        for c in ALL
    )
    + """) SELECT symbol, "column", missing, missing * 100.0 / n AS missing_pct,
  CASE WHEN missing * 100.0 / n > 5 THEN 'error' WHEN missing > 0 THEN 'warning' ELSE 'ok' END AS severity
FROM a""",
)
def v2(spark, sf):
    return va.missing_profile(gappy(spark, sf))


OHLC_SQL = """count(*) FILTER (high < greatest(open, close)) AS high_violations,
  count(*) FILTER (low > least(open, close)) AS low_violations,
  count(*) FILTER (high < low) AS high_low_violations, """ + ", ".join(
    f"count(*) FILTER ({c} <= 0) AS non_positive_{c}" for c in PX
)


@query(
    "v3_ohlc_violations",
    "symbol high_violations:i low_violations:i high_low_violations:i "
    + " ".join(f"non_positive_{c}:i" for c in PX),
    f"WITH {BROKEN_CTE} SELECT symbol, {OHLC_SQL} FROM broken GROUP BY 1",
)
def v3(spark, sf):
    return va.ohlc_violations(broken(spark, sf))


STEPS = f""", steps AS (SELECT *, abs(close / lag(close) OVER w - 1) AS move,
  epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER w / 1e6 AS gap_s, lag(ts) OVER w AS prev_ts
  FROM bars {W})"""


@query(
    "v4_extreme_moves",
    "symbol extreme_moves:i max_move:d",
    BARS
    + STEPS
    + "SELECT symbol, count(*) FILTER (move > 0.2) AS extreme_moves, max(move) AS max_move FROM steps GROUP BY 1",
)
def v4(spark, sf):
    return va.extreme_moves(bars(spark, sf))


@query(
    "v5_volume_checks",
    "symbol rows:i negative_volume:i zero_volume:i volume_q50:d volume_q99:d erroneous_high:i "
    "zero_share:d zero_error zero_warning",
    f"""WITH {BROKEN_CTE}, q AS (SELECT symbol, quantile_cont(volume, 0.5) AS volume_q50,
  quantile_cont(volume, 0.99) AS volume_q99 FROM broken GROUP BY 1),
a AS (SELECT symbol, count(*) AS rows, count(*) FILTER (volume < 0) AS negative_volume,
  count(*) FILTER (volume = 0) AS zero_volume, any_value(volume_q50) AS volume_q50,
  any_value(volume_q99) AS volume_q99,
  count(*) FILTER (volume_q99 > volume_q50 * 1.0 AND volume > volume_q99) AS erroneous_high
  FROM broken JOIN q USING (symbol) GROUP BY 1)
SELECT *, zero_volume / rows AS zero_share, zero_volume / rows > 0.1 AS zero_error,
  zero_volume / rows > 0.05 AS zero_warning FROM a""",
)
def v5(spark, sf):
    return va.volume_checks(broken(spark, sf), spread=1.0)


@query(
    "v6_duplicate_times",
    "symbol duplicates:i",
    f"WITH {REPEATS_CTE} SELECT symbol, count(*) - count(DISTINCT ts) AS duplicates FROM rep GROUP BY 1",
)
def v6(spark, sf):
    return va.duplicate_times(bars_with_repeats(spark, sf))


@query(
    "v7_chronological_order",
    "symbol out_of_order:i is_ordered",
    """WITH s AS (SELECT o_orderpriority AS symbol,
  lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) > o_orderdate AS back FROM orders)
SELECT symbol, count(*) FILTER (back) AS out_of_order, count(*) FILTER (back) = 0 AS is_ordered
FROM s GROUP BY 1""",
)
def v7(spark, sf):
    from barloom.catalog.base import table

    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("ingest_id"),
    )
    return va.chronological_order(o)


@query(
    "v8_large_gaps",
    "symbol median_gap_s:d3 large_gaps:i",
    f"""WITH s AS (SELECT event_type AS symbol,
  epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) / 1e6 AS gap_s FROM events),
m AS (SELECT symbol, median(gap_s) AS median_gap_s FROM s GROUP BY 1)
SELECT symbol, any_value(median_gap_s) AS median_gap_s,
  count(*) FILTER (gap_s > 10 * median_gap_s) AS large_gaps FROM s JOIN m USING (symbol) GROUP BY 1""",
)
def v8(spark, sf):
    t = ticks(spark, sf).withColumn("close", F.col("value"))
    return va.large_gaps(t, width="fit")


@query(
    "v9_gap_list",
    "symbol gap_start gap_end gap_s:d",
    BARS
    + STEPS
    + "SELECT symbol, prev_ts AS gap_start, ts AS gap_end, gap_s FROM steps WHERE gap_s > 1.5 * 3600",
)
def v9(spark, sf):
    return va.gap_list(bars(spark, sf), 3600)


@query(
    "v9_largest_gap",
    "symbol gaps:i largest_gap_s:d",
    BARS
    + STEPS
    + """SELECT symbol, count(*) AS gaps, max(gap_s) AS largest_gap_s FROM steps
WHERE gap_s > 1.5 * 3600 GROUP BY 1""",
)
def v9b(spark, sf):
    return va.largest_gap(bars(spark, sf), 3600)


LONG = " UNION ALL ".join(f"SELECT symbol, '{c}' AS \"column\", {c} AS v FROM bars" for c in PX)


@query(
    "v10_repeated_share",
    "symbol column repeated_pct:d is_repeated",
    BARS
    + f""", l AS ({LONG}), n AS (SELECT symbol, "column", v, count(*) AS n FROM l GROUP BY 1, 2, 3)
SELECT symbol, "column", max(n) * 100.0 / sum(n) AS repeated_pct, max(n) * 100.0 / sum(n) > 10 AS is_repeated
FROM n GROUP BY 1, 2""",
)
def v10(spark, sf):
    return va.repeated_share(bars(spark, sf))


@query(
    "v11_uniqueness",
    "symbol column unique_pct:d is_stagnant",
    BARS
    + f""", l AS ({LONG}) SELECT symbol, "column", count(DISTINCT v) * 100.0 / count(*) AS unique_pct,
  count(DISTINCT v) * 100.0 / count(*) < 50 AS is_stagnant FROM l GROUP BY 1, 2""",
)
def v11(spark, sf):
    return va.uniqueness(bars(spark, sf))


CONSISTENCY_SQL = (
    f"WITH {BROKEN_CTE}, "
    + f"""st AS (SELECT *, abs(try_cast(close / nullif(lag(close) OVER w, 0) AS DOUBLE) - 1) AS move,
  epoch_us(ts) / 1e6 - lag(epoch_us(ts)) OVER w / 1e6 AS gap_s FROM broken {W}),
m AS (SELECT symbol, median(gap_s) AS mg FROM st GROUP BY 1),
a AS (SELECT symbol, count(*) AS rows, {OHLC_SQL}, count(*) FILTER (volume < 0) AS neg,
  count(*) FILTER (volume = 0) AS zero, count(*) FILTER (move > 0.2) AS ext,
  count(*) - count(DISTINCT ts) AS dup, count(*) FILTER (gap_s > 10 * mg) AS gaps
  FROM st JOIN m USING (symbol) GROUP BY 1),
e AS (SELECT symbol, rows, (high_violations > 0)::INT + (low_violations > 0)::INT
  + (high_low_violations > 0)::INT + {' + '.join(f'(non_positive_{c} > 0)::INT' for c in PX)}
  + (ext > 0)::INT + (neg > 0)::INT + (zero > rows * 0.1)::INT + (dup > 0)::INT + (gaps > 0)::INT AS n_errors
  FROM a)"""
)


@query(
    "v12_quality_report",
    "symbol rows:i avg_missing_pct:d n_errors:i n_warnings:i outliers:i outlier_pct:d quality_score:d is_valid",
    CONSISTENCY_SQL
    + f""", z AS (SELECT symbol, {' OR '.join(
        f'abs({c} - avg({c}) OVER (PARTITION BY symbol)) / stddev_pop({c}) OVER (PARTITION BY symbol) > 3.0'
        for c in ALL)} AS odd FROM broken),
o AS (SELECT symbol, count(*) FILTER (odd) AS outliers FROM z GROUP BY 1),
wc AS (SELECT symbol, {', '.join(f'max(c_{c}) AS m_{c}' for c in PX)} FROM (SELECT symbol, {', '.join(
    f'count(*) OVER (PARTITION BY symbol, {c}) AS c_{c}' for c in PX)} FROM broken) GROUP BY 1),
wn AS (SELECT a.symbol, (rows < 1000)::INT + (zero * 100.0 / rows > 5)::INT
  + {' + '.join(f'(m_{c} * 100.0 / rows > 10)::INT' for c in PX)} AS n_warnings FROM a JOIN wc USING (symbol))
SELECT symbol, rows, n_warnings, 0.0 AS avg_missing_pct, n_errors, outliers, outliers * 100.0 / rows AS outlier_pct,
  greatest(100 - least(n_errors * 10, 40) - least(outliers * 100.0 / rows, 20), 0) AS quality_score,
  n_errors = 0 AS is_valid FROM e JOIN o USING (symbol) JOIN wn USING (symbol)""",
)
def v12(spark, sf):
    return va.quality_report(broken(spark, sf)).withColumn("n_warnings", F.size("warnings"))


@query(
    "v13_integrity_report",
    "symbol ohlc_consistency temporal_consistency volume_consistency n_issues:i n_warnings:i is_valid",
    f"""WITH {BROKEN_CTE}, a AS (SELECT symbol, count(*) AS rows, {OHLC_SQL},
  count(*) FILTER (volume < 0) AS neg, count(*) FILTER (volume = 0) AS zero,
  count(*) - count(DISTINCT ts) AS dup, quantile_cont(volume, 0.99) AS q99,
  quantile_cont(volume, 0.5) AS q50, {', '.join(f'count(DISTINCT {c}) AS u_{c}' for c in PX)}
  FROM broken GROUP BY 1),
n AS (SELECT symbol, (high_violations > 0)::INT + (low_violations > 0)::INT
  + (high_low_violations > 0)::INT + {' + '.join(f'(non_positive_{c} > 0)::INT' for c in PX)} AS p,
  (dup > 0)::INT AS t, (neg > 0)::INT + (q99 > q50 * 100)::INT AS v,
  (rows < 1000)::INT + (zero > rows * 0.1)::INT
  + {' + '.join(f'(u_{c} * 100.0 / rows < 50)::INT' for c in PX)} AS n_warnings FROM a)
SELECT symbol, p = 0 AS ohlc_consistency, t = 0 AS temporal_consistency, v = 0 AS volume_consistency,
  p + t + v AS n_issues, n_warnings, p + t + v = 0 AS is_valid FROM n""",
)
def v13(spark, sf):
    r = va.integrity_report(broken(spark, sf))
    return r.withColumns({"n_issues": F.size("issues"), "n_warnings": F.size("warnings")})


@query(
    "v14_dataset_summary",
    "symbol rows:i start end trading_days:i price_mean:d price_std:d return_volatility:d",
    BARS
    + f""", s AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars {W})
SELECT symbol, count(*) AS rows, min(ts) AS start, max(ts) AS "end",
  count(DISTINCT CAST(ts AS DATE)) AS trading_days, avg(close) AS price_mean,
  stddev_samp(close) AS price_std, stddev_samp(ret) AS return_volatility FROM s GROUP BY 1""",
)
def v14(spark, sf):
    return va.dataset_summary(bars(spark, sf))
