"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, bars, bars_sql, day_bars, DAY_BARS, query, table, ticks
from barloom.catalog.base import W
from barloom.operators.metrics import hourly_rate
from barloom.plans.series import columns_step, over_series
from barloom.session import set_checkpoint_folder
from barloom.sources import files
from barloom.sources.ticks import last_tick, ticks_to_bars

OHLCV_COLS = "symbol ts open:d high:d low:d close:d volume:d"


def shared_folder(spark, name: str) -> str:
    """Scratch place for write-then-read queries, in the folder that checkpoints use: an error on a
    cluster that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        set_checkpoint_folder(spark)
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(
    "s1_read_csv",
    OHLCV_COLS,
    BARS + "SELECT * FROM bars",
)
def s1(spark, sf):
    path = shared_folder(spark, "s1")
    out = bars(spark, sf).select(
        F.col("symbol").alias("Symbol"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.col("open").alias("O"),
        F.col("high").alias("HIGH"),
        F.col("low").alias("Low"),
        F.col("close").alias("c"),
        F.col("volume").alias("Vol"),
    )
    out.write.mode("overwrite").csv(path, header=True, sep=";")
    return files.read_bar_csv(spark, path, symbol_column="Symbol")


@query(
    "s2_map_columns",
    "datetime open:d high:d low:d close:d volume:d",
    "SELECT ts AS datetime, value AS open, value AS high, value AS low, value AS close, "
    "user_id AS volume FROM events",
)
def s2(spark, sf):
    e = table(spark, sf, "events")
    odd = e.select(
        F.col("ts").alias("TimeStamp"),
        F.col("value").alias("O"),
        F.col("value").alias("High"),
        F.col("value").alias("l"),
        F.col("value").alias("CLOSE"),
        F.col("user_id").alias("VOL"),
    )
    return files.map_columns(odd)


@query(
    "s3_load_range",
    OHLCV_COLS,
    BARS
    + """SELECT * FROM bars WHERE symbol IN ('click', 'view')
  AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'""",
)
def s3(spark, sf):
    path = shared_folder(spark, "s3")
    files.write_table(bars(spark, sf), path)
    return files.read_table(
        spark,
        path,
        symbols=["click", "view"],
        start="2024-01-03 00:00:00",
        end="2024-01-20 12:00:00",
    )


@query(
    "s4_parse_and_sort",
    "symbol ts value:d n:i",
    """SELECT event_type AS symbol, date_trunc('second', ts) AS ts, value,
  row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events""",
)
def s4(spark, sf):
    from barloom.plans.ordered import with_position

    t = ticks(spark, sf)
    text = t.withColumn("datetime", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    text = with_position(text, out="n", width="fit").drop("ts")
    return files.parse_times(text).orderBy("symbol", "n")


@query("s5_text_lines", OHLCV_COLS, BARS + "SELECT * FROM bars")
def s5(spark, sf):
    b = bars(spark, sf)
    line = F.concat_ws(
        " ",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ssXXX"),
        *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")],
    )
    lines = b.select("symbol", F.concat(F.lit("  "), line).alias("value"))
    lines = lines.unionByName(b.select("symbol", F.lit("short line only").alias("value")))
    return files.parse_bar_lines(lines)


@query("s6_ticks_to_bars", OHLCV_COLS, BARS + "SELECT * FROM bars")
def s6(spark, sf):
    return bars(spark, sf)


@query("s6_ticks_to_day_bars", OHLCV_COLS, DAY_BARS + "SELECT * FROM bars")
def s6_day(spark, sf):
    return day_bars(spark, sf)


@query(
    "s6_lineitem_bars",
    "symbol ts open:d high:d low:d close:d volume:d",
    """SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS ts,
  arg_min(l_extendedprice, (l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high,
  min(l_extendedprice) AS low, arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2""",
)
def s6_line(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("value"),
        "l_quantity",
        "l_orderkey",
        "l_linenumber",
    )
    order = F.struct("l_orderkey", "l_linenumber")
    return ticks_to_bars(li, "1 day", order=order, volume=F.col("l_quantity"))


@query(
    "s6_last_tick",
    "symbol ts last:d",
    """SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts,
  arg_max(value, ts) AS last FROM events GROUP BY 1, 2""",
)
def s6_last(spark, sf):
    return last_tick(ticks(spark, sf))


@query(
    "s7_write_feature_table",
    "symbol ts close:d sma_5:d",
    BARS
    + f"""SELECT symbol, ts, close,
  CASE WHEN count(close) OVER (w ROWS 4 PRECEDING) = 5 THEN avg(close) OVER (w ROWS 4 PRECEDING)
  END AS sma_5 FROM bars {W}""",
)
def s7(spark, sf):
    path = shared_folder(spark, "s7")
    df = over_series(
        bars(spark, sf), columns_step(lambda f: {"sma_5": f.roll(F.avg, "close", 5)}, back=4)
    )
    files.write_table(df.select("symbol", "ts", "close", "sma_5"), path)
    return spark.read.parquet(path)


@query(
    "s8_read_trade_table",
    "symbol trades:i total:d",
    """SELECT event_type AS symbol, count(*) AS trades, sum(value) AS total
  FROM events GROUP BY 1""",
)
def s8(spark, sf):
    path = shared_folder(spark, "s8")
    t = ticks(spark, sf).select("symbol", F.col("value").alias("pnl_pct"))
    files.write_table(t, path, fmt="csv", partition_by=(), order=None)
    trades = files.read_trades(spark, path)
    return trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl_pct").alias("total")
    )


FLAGSHIP_SQL = f"""
WITH {bars_sql()},
s AS (SELECT *, avg(close) OVER (w ROWS 7 PRECEDING) AS fast,
        avg(close) OVER (w ROWS 29 PRECEDING) AS slow,
        row_number() OVER w AS rn FROM bars {W}),
x AS (SELECT *, fast > slow AND lag(fast) OVER w <= lag(slow) OVER w AND rn > 30 AS up
      FROM s {W})
SELECT hour(ts) AS hour, sum(CASE WHEN up THEN 1 ELSE 0 END) AS wins, count(*) AS total,
  sum(CASE WHEN up THEN 1 ELSE 0 END) * 100.0 / count(*) AS rate
FROM x GROUP BY 1"""


@query("flagship_sma_cross_by_hour", "hour:i wins:i total:i rate:d", FLAGSHIP_SQL)
def flagship(spark, sf):
    """Ticks to bars, forward fill, crossing moving averages, crossings per hour of day."""
    from barloom.operators.cleaning import forward_fill
    from barloom.operators.windows import cross_flags

    b = forward_fill(bars(spark, sf))
    means = columns_step(
        lambda f: {"fast": f.roll(F.avg, "close", 8), "slow": f.roll(F.avg, "close", 30)}, back=29
    )
    df = over_series(b, means, cross_flags("fast", "slow", "up", "down", back=30))
    return hourly_rate(df, F.col("up"))
