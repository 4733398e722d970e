"""Risk queries: bars as signals, order sets as portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, W, bars, bars_sql, query, table
from barloom.operators import risk as rk

# Every bar as a request: long when it rose, confidence from the close's place in the range.
REQ = BARS + """, req AS (SELECT symbol AS portfolio, ts, close AS price, close AS entry_price, high - low AS atr,
  CASE WHEN close > open THEN 'long' ELSE 'short' END AS position_type,
  CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS confidence,
  10000.0 + volume * 100 AS portfolio_value FROM bars)"""


def requests(spark, sf):
    b = bars(spark, sf)
    span = F.col("high") - F.col("low")
    return b.select(
        F.col("symbol").alias("portfolio"),
        "ts",
        F.col("close").alias("price"),
        F.col("close").alias("entry_price"),
        span.alias("atr"),
        F.when(F.col("close") > F.col("open"), "long").otherwise("short").alias("position_type"),
        F.when(span > 0, (F.col("close") - F.col("low")) / span).otherwise(0.5).alias("confidence"),
        (F.lit(10000.0) + F.col("volume") * 100).alias("portfolio_value"),
    )


SIZE = "greatest(portfolio_value * 0.02 * confidence, 100) / price"


@query(
    "x1_position_size",
    "portfolio ts size_pct:d size_atr:d",
    REQ
    + f"""SELECT portfolio, ts, round(least({SIZE}, portfolio_value * 0.02 / (price * 0.01)), 2) AS size_pct,
  round(CASE WHEN atr > 0 THEN least({SIZE}, portfolio_value * 0.02 / (atr * 2.0)) ELSE {SIZE} END, 2) AS size_atr FROM req""",
)
def x1(spark, sf):
    return requests(spark, sf).withColumns(
        {"size_pct": rk.position_size(), "size_atr": rk.position_size(method="atr")}
    )


def _stop(d):
    return f"round(entry_price - ({d}) * CASE WHEN position_type = 'long' THEN 1 ELSE -1 END, 4)"


def _take(d):
    return f"round(entry_price + ({d}) * CASE WHEN position_type = 'long' THEN 1 ELSE -1 END, 4)"


@query(
    "x2_stop_price",
    "portfolio ts pct:d4 atr_stop:d4 fixed:d4",
    REQ
    + f"SELECT portfolio, ts, {_stop('entry_price * 0.01')} AS pct, {_stop('atr * 2.0')} AS atr_stop, {_stop('entry_price * 0.01')} AS fixed FROM req",
)
def x2(spark, sf):
    return requests(spark, sf).withColumns(
        {
            "pct": rk.stop_price(),
            "atr_stop": rk.stop_price(method="atr"),
            "fixed": rk.stop_price(method="fixed"),
        }
    )


@query(
    "x3_profit_price",
    "portfolio ts pct:d4 atr_take:d4 rr:d4",
    REQ
    + f"""SELECT portfolio, ts, {_take('entry_price * 0.02')} AS pct, {_take('atr * 4.0')} AS atr_take,
  {_take(f"abs(entry_price - {_stop('atr * 2.0')}) * 2.0")} AS rr FROM req""",
)
def x3(spark, sf):
    d = requests(spark, sf).withColumn("stop_price", rk.stop_price(method="atr"))
    return d.withColumns(
        {
            "pct": rk.profit_price(),
            "atr_take": rk.profit_price(method="atr"),
            "rr": rk.profit_price(method="risk_reward"),
        }
    )


# Orders of one customer as a portfolio of open positions.
POS = """WITH pos AS (SELECT o_custkey AS portfolio, o_orderkey AS position_id, o_orderdate AS ts,
  o_totalprice AS position_value, 8000000.0 AS portfolio_value FROM orders)"""


def positions(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("portfolio"),
        F.col("o_orderkey").alias("position_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("position_value"),
        F.lit(8000000.0).alias("portfolio_value"),
    )


STATE = POS + """, st AS (SELECT portfolio, count(*) AS position_count, sum(position_value) / 8000000.0 AS total_risk,
  max(position_value) / 8000000.0 AS largest_position_pct FROM pos GROUP BY 1),
req AS (SELECT c_custkey AS portfolio, c_acctbal AS size, 50.0 AS price, 8000000.0 AS portfolio_value FROM customer)"""


def checked(spark, sf):
    req = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("portfolio"),
        F.col("c_acctbal").alias("size"),
        F.lit(50.0).alias("price"),
    )
    state = rk.portfolio_state(positions(spark, sf)).drop("portfolio_value")
    req = req.withColumn("portfolio_value", F.lit(8000000.0))
    return rk.limit_violations(req, state, limits=rk.RiskLimits(max_positions=12, max_portfolio_risk=0.4))


@query(
    "x4_limit_violations",
    "portfolio violation_type current_value:d severity accepted",
    STATE
    + """, j AS (SELECT r.portfolio, coalesce(position_count, 0) AS n, size * price / r.portfolio_value AS share,
  coalesce(total_risk, 0) + size * price / r.portfolio_value AS total FROM req r LEFT JOIN st USING (portfolio)),
v AS (SELECT portfolio, 'max_positions' AS violation_type, n AS current_value, 'critical' AS severity FROM j WHERE n >= 12
  UNION ALL SELECT portfolio, 'position_size', share, 'critical' FROM j WHERE share > 0.02
  UNION ALL SELECT portfolio, 'portfolio_risk', total, 'warning' FROM j WHERE total > 0.4)
SELECT *, NOT max(severity = 'critical') OVER (PARTITION BY portfolio) AS accepted FROM v""",
)
def x4(spark, sf):
    return rk.violation_rows(checked(spark, sf), ["portfolio", "accepted"])


OPEN = BARS + """, op AS (SELECT symbol, ts, close AS entry_price,
  CASE WHEN close > open THEN 'long' ELSE 'short' END AS position_type,
  close * CASE WHEN close > open THEN 0.7 ELSE 1.3 END AS stop_price,
  close * CASE WHEN close > open THEN 1.5 ELSE 0.5 END AS profit_price FROM bars),
lst AS (SELECT symbol, arg_max(close, ts) AS current_price FROM bars GROUP BY 1)"""


def open_positions(spark, sf):
    b = bars(spark, sf)
    up = F.col("close") > F.col("open")
    return b.select(
        "symbol",
        "ts",
        F.col("close").alias("entry_price"),
        F.when(up, "long").otherwise("short").alias("position_type"),
        (F.col("close") * F.when(up, 0.7).otherwise(1.3)).alias("stop_price"),
        (F.col("close") * F.when(up, 1.5).otherwise(0.5)).alias("profit_price"),
    )


@query(
    "x5_triggers",
    "symbol ts stop_hit target_hit",
    OPEN
    + """SELECT op.symbol, ts, CASE WHEN position_type = 'long' THEN current_price <= stop_price ELSE current_price >= stop_price END AS stop_hit,
  CASE WHEN position_type = 'long' THEN current_price >= profit_price ELSE current_price <= profit_price END AS target_hit
FROM op JOIN lst USING (symbol)""",
)
def x5(spark, sf):
    from barloom.operators.positions import with_latest_price

    p = with_latest_price(open_positions(spark, sf), bars(spark, sf))
    return p.withColumns(rk.triggers())


@query(
    "x6_trailing_stops",
    "position_id ts trailing_stop:d4",
    BARS
    + """, px AS (SELECT symbol AS position_id, ts, close AS price,
  CASE WHEN symbol IN ('click', 'view') THEN 'long' ELSE 'short' END AS position_type,
  CASE WHEN symbol IN ('click', 'view') THEN 20.0 ELSE 200.0 END AS stop_price FROM bars)
SELECT position_id, ts, CASE WHEN position_type = 'long'
  THEN greatest(max(round(price * (1 - 0.01), 4)) OVER (w ROWS UNBOUNDED PRECEDING), stop_price)
  ELSE least(min(round(price * (1 + 0.01), 4)) OVER (w ROWS UNBOUNDED PRECEDING), stop_price) END AS trailing_stop
FROM px WINDOW w AS (PARTITION BY position_id ORDER BY ts)""",
)
def x6(spark, sf):
    long = F.col("symbol").isin("click", "view")
    px = bars(spark, sf).select(
        F.col("symbol").alias("position_id"),
        "ts",
        F.col("close").alias("price"),
        F.when(long, "long").otherwise("short").alias("position_type"),
        F.when(long, 20.0).otherwise(200.0).alias("stop_price"),
    )
    return rk.trailing_stops(px, pct=0.01)


EQUITY = BARS + """, eq AS (SELECT symbol AS portfolio, ts, 10000 + close * 50 AS value FROM bars),
dd AS (SELECT *, (max(value) OVER w - value) / max(value) OVER w AS drawdown FROM eq
  WINDOW w AS (PARTITION BY portfolio ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


def equity(spark, sf):
    return bars(spark, sf).select(
        F.col("symbol").alias("portfolio"), "ts", (F.lit(10000) + F.col("close") * 50).alias("value")
    )


@query(
    "x7_drawdown",
    "portfolio ts drawdown:d limit_breached emergency",
    EQUITY + "SELECT portfolio, ts, drawdown, drawdown > 0.10 AS limit_breached, drawdown > 0.15 AS emergency FROM dd",
)
def x7(spark, sf):
    return rk.drawdown(equity(spark, sf))


@query(
    "x8_max_drawdown",
    "portfolio max_drawdown:d",
    EQUITY + "SELECT portfolio, max(drawdown) AS max_drawdown FROM dd GROUP BY 1",
)
def x8(spark, sf):
    return rk.max_drawdown_of(equity(spark, sf))


@query(
    "x9_portfolio_metrics",
    "portfolio position_count:i total_risk:d largest_position_pct:d",
    STATE + "SELECT * FROM st",
)
def x9(spark, sf):
    return rk.portfolio_state(positions(spark, sf))


@query(
    "x9_risk_metrics",
    "portfolio position_count:i total_risk:d current_drawdown:d max_drawdown:d",
    EQUITY
    + """, p AS (SELECT symbol AS portfolio, count(*) AS position_count, sum(close) / 100000.0 AS total_risk FROM bars GROUP BY 1),
m AS (SELECT portfolio, arg_max(drawdown, ts) AS current_drawdown, max(drawdown) AS max_drawdown FROM dd GROUP BY 1)
SELECT * FROM p JOIN m USING (portfolio)""",
)
def x9b(spark, sf):
    pos = bars(spark, sf).select(
        F.col("symbol").alias("portfolio"),
        F.col("close").alias("position_value"),
        F.lit(100000.0).alias("portfolio_value"),
    )
    return rk.risk_metrics(pos, equity(spark, sf))


VIOL = "WITH v AS (SELECT event_type AS violation_type, ts, value, CASE WHEN value > 50 THEN 'critical' ELSE 'warning' END AS severity FROM events)"


def violations(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("violation_type"),
        "ts",
        "value",
        F.when(F.col("value") > 50, "critical").otherwise("warning").alias("severity"),
    )


@query(
    "x10_recent_violations",
    "violation_type ts value:d severity",
    VIOL + "SELECT * FROM v WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOUR",
)
def x10(spark, sf):
    return rk.recent_violations(violations(spark, sf), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))


@query(
    "x10_recent_violations_part_hours",
    "violation_type ts value:d severity",
    VIOL + "SELECT * FROM v WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 90 MINUTE",
)
def x10_part(spark, sf):
    return rk.recent_violations(
        violations(spark, sf), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), hours=1.5
    )


@query(
    "x10_purge_violations",
    "violation_type critical:i warnings:i",
    VIOL
    + """SELECT violation_type, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'warning') AS warnings FROM v
WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY GROUP BY 1""",
)
def x10b(spark, sf):
    v = rk.purge_violations(violations(spark, sf), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))
    return rk.violation_counts(v)
