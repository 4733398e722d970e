"""Streaming queries: each stream runs over the tables to completion and must equal the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, bars, query, table
from barloom.catalog.cleaning import REPEATS_CTE, bars_with_repeats
from barloom.catalog.ingest import shared_folder
from barloom.catalog.recursive import BASE, W, a, recur
from barloom.catalog.risk import EQUITY, equity
from barloom.catalog.signals import SMOOTH, scored
from barloom.catalog.validation import BROKEN_CTE, broken
from barloom.catalog.windows import TR, lag
from barloom.operators import signals as sg
from barloom.session import durable
from barloom.streaming import bars as sb
from barloom.streaming import state as ss
from barloom.streaming.replay import closing_mark, file_stream, replay, run_batches, run_to_table


def event_ticks(spark, sf):
    """The events table as a stream of ticks."""
    schema = table(spark, sf, "events").schema
    e = file_stream(spark, sf, schema, "events.parquet")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")


def in_spans(spark, df, name, build, parts=3, sink=None, ends=False):
    """Replay a derived table: equal spans of its time arrive one after another, each as many files
    in any order and taken as a micro-batch, on one checkpoint; with ``ends`` a closing mark follows.
    Returns the output (or the folder, where ``sink`` takes the batches) and all progress reports."""
    folder = shared_folder(spark, name)
    data = durable(df.withColumn("ts", F.col("ts").cast("timestamp")))
    second = F.unix_timestamp("ts")
    first, last = data.agg(F.min(second), F.max(second)).first()
    span = F.lit(0) if first is None else F.floor((second - first) * parts / (last - first + 1))
    stream, reports = None, []
    fed = [data.filter(span == i) for i in range(1 if first is None else parts)]
    for i, rows in enumerate([*fed, closing_mark(data)] if ends else fed):
        rows.write.parquet(f"{folder}/in/part={i}")
        stream = stream or build(file_stream(spark, f"{folder}/in", data.schema, files=ALL))
        if sink is None:
            reports += run_to_table(stream, f"{folder}/run")
        else:
            run_batches(stream, f"{folder}/run", lambda rows, k: sink(folder, rows, k))
    if sink is not None:
        return folder, reports
    return spark.read.schema(stream.schema).parquet(f"{folder}/run/out"), reports


def wall(df, *cols):
    """Back to zone-less times, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


#: Files of one micro-batch: all there are.
ALL = 1_000_000
#: Rows of a result that the watermark of ten minutes has passed.
PASSED = "WITH RECURSIVE told AS ({}) SELECT * FROM told WHERE ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM told)"

CLOSED = ", mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events) "


@query(
    "z1_stream_bars",
    "symbol ts open:d high:d low:d close:d volume:d",
    BARS + CLOSED + "SELECT bars.* FROM bars, mark WHERE ts + INTERVAL 1 HOUR <= wm",
)
def z1(spark, sf):
    out = sb.stream_bars(event_ticks(spark, sf))
    return wall(replay(out, shared_folder(spark, "z1")), "ts")


@query(
    "z1_sliding_bars",
    "symbol ts high:d low:d volume:d",
    """WITH s AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) - INTERVAL 1 HOUR * k AS ts, value
  FROM events, (VALUES (0), (1)) v(k)), mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)
SELECT symbol, s.ts, max(value) AS high, min(value) AS low, count(*) AS volume FROM s, mark
WHERE s.ts + INTERVAL 2 HOUR <= wm GROUP BY 1, 2""",
)
def z1s(spark, sf):
    out = sb.stream_bars(event_ticks(spark, sf), "2 hours", slide="1 hour")
    return wall(replay(out, shared_folder(spark, "z1s")), "ts")


@query(
    "z2_stream_dedup",
    "symbol ts",
    f"WITH {REPEATS_CTE} SELECT DISTINCT symbol, ts FROM rep",
)
def z2(spark, sf):
    rows = bars_with_repeats(spark, sf).select("symbol", "ts")
    return wall(in_spans(spark, rows, "z2", sb.stream_dedup)[0], "ts")


@query(
    "z3_late_rows",
    "symbol kept_ticks:i late_ticks:i late_value:d",
    """WITH mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events),
k AS (SELECT event_type AS symbol, count(*) AS kept_ticks FROM events, mark
  WHERE day(ts) >= 15 AND time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR <= wm GROUP BY 1),
l AS (SELECT event_type AS symbol, count(*) AS late_ticks, sum(value) AS late_value FROM events WHERE day(ts) < 15 GROUP BY 1)
SELECT * FROM k FULL JOIN l USING (symbol)""",
)
def z3(spark, sf):
    """Ticks in bars and ticks that came too late, which are kept in a table of their own: the first
    half of the time line arrives last."""
    t = table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )
    folder = shared_folder(spark, "z3")
    late = sb.late_sink(f"{folder}/late", "1 hour")
    for i, part in enumerate((F.dayofmonth("ts") >= 15, F.dayofmonth("ts") < 15)):
        t.filter(part).write.parquet(f"{folder}/in/part={i}")
        stream = file_stream(spark, f"{folder}/in", t.schema, files=ALL)
        run_to_table(sb.stream_bars(stream), f"{folder}/bars")
        run_batches(stream, f"{folder}/side", late)
    kept = spark.read.parquet(f"{folder}/bars/out").groupBy("symbol").agg(F.sum("volume").alias("kept_ticks"))
    lost = spark.read.schema(t.schema).parquet(f"{folder}/late/rows")
    lost = lost.groupBy("symbol").agg(F.count("*").alias("late_ticks"), F.sum("value").alias("late_value"))
    return kept.join(lost, "symbol", "full")


INDICATORS = (
    f"WITH RECURSIVE {BASE}, "
    + f"""d AS (SELECT *, greatest(close - {lag('close')}, 0) AS up, greatest({lag('close')} - close, 0) AS dn,
  {TR} AS tr FROM n {W}), """
    + recur("e", "n", {"ema": ("close", a(21))})
    + ", "
    + recur("g", "d", {"g": ("up", 1 / 14), "l": ("dn", 1 / 14), "atr": ("tr", 1 / 14)}, 1)
    + """ SELECT n.symbol, n.ts, ema, 100 * g / nullif(g + l, 0) AS rsi, atr
  FROM n JOIN e USING (symbol, rn) LEFT JOIN g USING (symbol, rn)"""
)


def known(out):
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("rsi", "atr")})


@query(
    "z4_online_indicators",
    "symbol ts ema:d rsi:d atr:d",
    INDICATORS,
)
def z4(spark, sf):
    out, _ = in_spans(spark, bars(spark, sf), "z4", ss.online_indicators, ends=True)
    return known(wall(out, "ts"))


@query(
    "z4_ticks_to_indicators",
    "symbol ts ema:d rsi:d atr:d",
    "WITH RECURSIVE told AS (" + INDICATORS + """)
SELECT * FROM told WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def z4_chain(spark, sf):
    """One stream from ticks over bars to indicators."""
    ticks = table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )

    def build(rows):
        return ss.online_indicators(sb.stream_bars_in_time(rows), ts="closed", delay=None)

    out, _ = in_spans(spark, ticks, "z4c", build)
    return known(wall(out.withColumn("ts", F.date_trunc("hour", "closed")), "ts"))


@query("z5_online_smoothed_signal", "symbol ts signal:i smoothed:i", PASSED.format(SMOOTH))
def z5(spark, sf):
    d = scored(spark, sf).withColumn("signal", sg.raw_signal()).select("symbol", "ts", "signal")
    return wall(in_spans(spark, d, "z5", ss.online_smoothed_signal)[0], "ts")


@query(
    "z6_online_trailing_stops",
    "position_id ts trailing_stop:d4",
    BARS
    + """, px AS (SELECT symbol AS position_id, ts, close AS price, symbol IN ('click', 'view') AS lng FROM bars)
SELECT position_id, ts, CASE WHEN lng
  THEN greatest(max(floor(price * (1 - 0.01) * 10000 + 0.5) / 10000) OVER w, 20.0)
  ELSE least(min(floor(price * (1 + 0.01) * 10000 + 0.5) / 10000) OVER w, 200.0) END AS trailing_stop
FROM px WINDOW w AS (PARTITION BY position_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
)
def z6(spark, sf):
    long = F.col("symbol").isin("click", "view")
    px = bars(spark, sf).select(
        F.col("symbol").alias("position_id"),
        "ts",
        F.col("close").alias("price"),
        F.when(long, "long").otherwise("short").alias("position_type"),
        F.when(long, 20.0).otherwise(200.0).alias("stop_price"),
    )
    out, _ = in_spans(spark, px, "z6", lambda rows: ss.online_trailing_stops(rows, pct=0.01), ends=True)
    return wall(out, "ts")


@query(
    "z7_stream_days",
    "symbol day rows:i last:d",
    """WITH d AS (SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS rows,
  arg_max(value, ts) AS last FROM events GROUP BY 1, 2)
SELECT d.* FROM d, (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events) WHERE day + INTERVAL 1 DAY <= wm""",
)
def z7(spark, sf):
    out = sb.stream_days(event_ticks(spark, sf))
    return wall(replay(out, shared_folder(spark, "z7")), "day")


@query(
    "z7_stream_sessions",
    "symbol start end rows:i total:d",
    """WITH g AS (SELECT event_type AS symbol, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS brk
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
o AS (SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 90 MINUTE AS "end", count(*) AS rows, sum(value) AS total FROM s GROUP BY symbol, sid)
SELECT o.* FROM o, (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events) WHERE "end" <= wm""",
)
def z7s(spark, sf):
    out = sb.stream_sessions(event_ticks(spark, sf), "90 minutes")
    return wall(replay(out, shared_folder(spark, "z7s")), "start", "end")


@query(
    "z8_online_drawdown",
    "portfolio ts drawdown:d limit_breached emergency",
    PASSED.format(
        EQUITY
        + "SELECT portfolio, ts, drawdown, drawdown > 0.10 AS limit_breached, drawdown > 0.15 AS emergency FROM dd"
    ),
)
def z8(spark, sf):
    return wall(in_spans(spark, equity(spark, sf), "z8", ss.online_drawdown)[0], "ts")


@query(
    "z9_stream_validation",
    "symbol ts n_issues:i",
    f"""WITH {BROKEN_CTE}, c AS (SELECT symbol, ts, (high < greatest(open, close))::INT + (low > least(open, close))::INT
  + (high < low)::INT + (open <= 0)::INT + (high <= 0)::INT + (low <= 0)::INT + (close <= 0)::INT + (volume < 0)::INT AS n_issues FROM broken)
SELECT * FROM c WHERE n_issues > 0""",
)
def z9(spark, sf):
    def sink(folder, rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    folder, _ = in_spans(spark, broken(spark, sf), "z9", sb.bad_bars, sink=sink)
    out = spark.read.parquet(f"{folder}/out")
    return wall(out.withColumn("n_issues", F.size("issues")), "ts")
