"""Table schemas and the header aliases of bar files."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("symbol",)
TS = "ts"
PRICES = ("open", "high", "low", "close")
OHLCV = PRICES + ("volume",)

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.DoubleType()) for c in OHLCV],
    ]
)

# Accepted header names (compared in lower case) of the six standard columns.
COLUMN_ALIASES = {
    "datetime": ("datetime", "timestamp", "time", "date"),
    "open": ("open", "o"),
    "high": ("high", "h"),
    "low": ("low", "l"),
    "close": ("close", "c"),
    "volume": ("volume", "vol", "v"),
}

TRADE_COLUMNS = (
    "entry_time",
    "entry_price",
    "exit_time",
    "exit_price",
    "exit_reason",
    "pnl_pct",
    "pnl_points",
    "pnl_r",
    "candles_held",
    "win",
)

SIGNAL_SCHEMA = T.StructType(
    [
        T.StructField("signal", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
