"""Join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, W, bars, query, table, ticks
from barloom.operators import cleaning as cl
from barloom.operators.positions import as_of_price, cross_parameters, union_entries, with_latest_price
from barloom.plans.barriers import path
from barloom.plans.quantiles import exact_quantiles, per_key
from barloom.plans.series import columns_step, over_series


@query(
    "j2_stats_join",
    "symbol ts close:d above_q3",
    BARS
    + """, q AS (SELECT symbol, quantile_cont(close, 0.75) AS q3 FROM bars GROUP BY 1)
SELECT symbol, ts, close, close > q3 AS above_q3 FROM bars JOIN q USING (symbol)""",
)
def j2(spark, sf):
    b = bars(spark, sf)
    out = per_key(b, exact_quantiles(b, {"close": (0.75,)}))
    return out.withColumn("above_q3", F.col("close") > F.col("q_close_0"))


@query(
    "j3_future_path",
    "symbol ts path_rows:i path_high:d path_low:d",
    BARS
    + f""", n AS (SELECT *, row_number() OVER w AS rn FROM bars {W})
SELECT a.symbol, a.ts, count(b.rn) AS path_rows, max(b.high) AS path_high, min(b.low) AS path_low
FROM n a LEFT JOIN n b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 10 GROUP BY 1, 2""",
)
def j3(spark, sf):
    step = columns_step(lambda f: {"p": path(f, ("high", "low"), 10)}, ahead=10)
    d = over_series(bars(spark, sf), step)
    return d.select(
        "symbol",
        "ts",
        F.size("p").alias("path_rows"),
        F.array_max(F.transform("p", lambda x: x["high"])).alias("path_high"),
        F.array_min(F.transform("p", lambda x: x["low"])).alias("path_low"),
    )


@query(
    "j4_cross_parameters",
    "symbol threshold:d hits:i",
    BARS
    + """SELECT symbol, t.threshold, count(*) FILTER (close / open - 1 >= t.threshold) AS hits
FROM bars, (VALUES (0.1), (0.5), (1.0)) t(threshold) GROUP BY 1, 2""",
)
def j4(spark, sf):
    params = spark.createDataFrame([(0.1,), (0.5,), (1.0,)], "threshold double")
    d = cross_parameters(bars(spark, sf), params)
    hit = F.col("close") / F.col("open") - 1 >= F.col("threshold")
    return d.groupBy("symbol", "threshold").agg(F.count(F.when(hit, 1)).alias("hits"))


@query(
    "j5_latest_price",
    "symbol event_id:i current_price:d",
    BARS
    + """, l AS (SELECT symbol, arg_max(close, ts) AS current_price FROM bars GROUP BY 1)
SELECT event_type AS symbol, event_id, current_price FROM events JOIN l ON l.symbol = event_type""",
)
def j5(spark, sf):
    pos = ticks(spark, sf).select("symbol", F.col("ingest_id").alias("event_id"))
    return with_latest_price(pos, bars(spark, sf))


@query(
    "j5_as_of_price",
    "symbol event_id:i current_price:d",
    BARS
    + """SELECT e.event_type AS symbol, e.event_id, b.close AS current_price
FROM events e ASOF LEFT JOIN bars b ON b.symbol = e.event_type AND e.ts >= b.ts""",
)
def j5b(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "event_id", F.col("ts").alias("asked")
    )
    return as_of_price(e, bars(spark, sf), at="asked")


@query(
    "u1_union_entries",
    "entry_set symbol n:i",
    BARS
    + """SELECT 'bearish' AS entry_set, symbol, count(*) AS n FROM bars WHERE close < open GROUP BY 2
UNION ALL SELECT 'bullish', symbol, count(*) FROM bars WHERE close > open GROUP BY 2""",
)
def u1(spark, sf):
    b = bars(spark, sf)
    both = union_entries({"bearish": b.filter("close < open"), "bullish": b.filter("close > open")})
    return both.groupBy("entry_set", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u2_distinct",
    "symbol ts",
    "SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts) AS ts FROM events",
)
def u2(spark, sf):
    t = ticks(spark, sf)
    hour = F.date_trunc("hour", "ts").cast(t.schema["ts"].dataType)
    return cl.keep_first(t.select("symbol", hour.alias("ts")))
