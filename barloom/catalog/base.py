"""Registry, shared inputs and the column contract of query and oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.ticks import ticks_to_bars

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def _spec(cols: str) -> list[tuple[str, str]]:
    return [tuple((c.split(":") + [""])[:2]) for c in cols.split()]


def query(name: str, cols: str | None = None, sql: str | None = None):
    """Register a query. ``cols`` names the result columns: plain, ``:i`` for 64-bit integers,
    ``:d`` or ``:d4`` for doubles rounded to 6 or 4 digits. Both sides are projected by it."""

    def register(fn: Query) -> Query:
        if cols is None:
            REGISTRY[name] = (fn, sql)
            return fn
        spec = _spec(cols)

        def run(spark, sf_dir):
            out = []
            for c, t in spec:
                if t == "i":
                    out.append(F.col(c).cast("bigint").alias(c))
                elif t.startswith("d"):
                    out.append((F.round(F.col(c).cast("double"), int(t[1:] or 6)) + 0.0).alias(c))
                else:
                    out.append(F.col(c))
            return fn(spark, sf_dir).select(*out)

        twin = None
        if sql is not None:
            out = []
            for c, t in spec:
                if t == "i":
                    out.append(f"CAST(\"{c}\" AS BIGINT) AS \"{c}\"")
                elif t.startswith("d"):
                    out.append(f"round(CAST(\"{c}\" AS DOUBLE), {int(t[1:] or 6)}) + 0.0 AS \"{c}\"")
                else:
                    out.append(f'"{c}"')
            twin = f"SELECT {', '.join(out)} FROM (\n{sql}\n) AS result"
        REGISTRY[name] = (run, twin)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: symbol, ts, value, ingest number."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", "value", F.col("event_id").alias("ingest_id")
    )


def bars(spark: SparkSession, sf_dir: str, every: str = "1 hour") -> DataFrame:
    """Bars of event values, one symbol per event type."""
    return ticks_to_bars(ticks(spark, sf_dir), every)


def bars_sql(every: str = "1 hour", name: str = "bars") -> str:
    return f"""{name} AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL '{every}', ts) AS ts,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""


BARS = "WITH " + bars_sql()
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals, one symbol per priority; ties of a day by order key."""
    t = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("value"),
        "o_orderkey",
    )
    return ticks_to_bars(t, "1 day", order=F.struct("ts", "o_orderkey"))


DAY_BARS = """WITH bars AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS ts,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""
