"""Bar files: delimited text with unknown separator and header names, and raw text lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import COLUMN_ALIASES, OHLCV

# Separators and encodings tried, in this order (Latin-1 takes any byte); fewest columns of a bar file.
SEPARATORS = (",", ";", "\t")
ENCODINGS = ("UTF-8", "ISO-8859-1")
MIN_COLUMNS = 5


class BarFileError(ValueError):
    pass


@dataclass(frozen=True)
class Layout:
    """How some files are written, and which."""

    separator: str
    encoding: str
    names: tuple[str, ...]
    files: tuple[str, ...]


def detect_layouts(spark: SparkSession, path: str) -> list[Layout]:
    """Layouts of all files below ``path``: separator and header names from each file's first line,
    encoding from its whole body (bytes that are not UTF-8 make it Latin-1, which takes any byte).
    Files are scanned once by Spark; their paths, which the reader needs, come to the driver."""
    broken = ~F.is_valid_utf8("value")
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("id"),
    )
    found = lines.groupBy("file").agg(
        F.min_by("value", F.struct("at", "id")).alias("header"), F.bool_or(broken).alias("latin")
    )
    alike = found.groupBy("header", "latin").agg(F.sort_array(F.collect_list("file")).alias("files"))
    out = []
    for r in alike.orderBy(F.col("files")[0]).collect():
        separator, names = _columns(r.header, r.files[0])
        out.append(Layout(separator, ENCODINGS[1] if r.latin else ENCODINGS[0], names, tuple(r.files)))
    if not out:
        raise BarFileError(f"nothing to read: {path}")
    return out


def _columns(header: str, file: str) -> tuple[str, tuple[str, ...]]:
    header = header.lstrip("\ufeff")
    for sep in SEPARATORS:
        names = tuple(h.strip().strip('"') for h in header.split(sep))
        if len(names) >= MIN_COLUMNS:
            return sep, names
    raise BarFileError(f"no known separator in the header of {file}")


def map_columns(df: DataFrame) -> DataFrame:
    """Rename header variants to the standard six; the first matching column wins."""
    renames = {}
    for standard, names in COLUMN_ALIASES.items():
        for c in df.columns:
            if c.lower() in names:
                renames[c] = standard
                break
    return df.withColumnsRenamed(renames)


def require_columns(df: DataFrame) -> DataFrame:
    missing = [c for c in ("datetime", *OHLCV) if c not in df.columns]
    if missing:
        raise BarFileError(f"missing required columns: {missing}")
    return df


def parse_times(df: DataFrame, column: str = "datetime", out: str = "ts") -> DataFrame:
    """Text times (with or without zone offset) as timestamps."""
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return df.withColumnRenamed(column, out)
    return df.withColumn(out, F.try_to_timestamp(column)).drop(*([column] if column != out else []))


def read_bar_csv(
    spark: SparkSession,
    path: str,
    *,
    symbol: str | None = None,
    symbol_column: str | None = None,
    ingest: bool = False,
) -> DataFrame:
    """Bars from delimited files, each read by its own layout; a header that lacks a bar column
    raises. All columns are read as text and cast, so no second pass infers types. The symbol is
    given, or comes from a column, or from the file name up to ``_``."""
    parts = [
        _read_layout(spark, layout, symbol, symbol_column, ingest)
        for layout in detect_layouts(spark, path)
    ]
    return reduce(DataFrame.unionByName, parts)


def _read_layout(spark, layout: Layout, symbol, symbol_column, ingest: bool) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in layout.names])
    raw = spark.read.csv(
        list(layout.files), schema=schema, header=True, sep=layout.separator, encoding=layout.encoding
    )
    df = require_columns(map_columns(raw))
    base = F.element_at(F.split(F.input_file_name(), "/"), -1)
    if symbol_column:
        name = F.col(symbol_column)
    else:
        name = F.lit(symbol) if symbol else F.element_at(F.split(base, "[_.]"), 1)
    cols = [name.alias("symbol"), "datetime"]
    cols += [F.trim(F.col(c)).try_cast("double").alias(c) for c in OHLCV]
    if ingest:
        cols.append(F.monotonically_increasing_id().alias("ingest_id"))
    return parse_times(df.select(*cols)).select(
        "symbol", "ts", *OHLCV, *(["ingest_id"] if ingest else [])
    )


def load_bars(
    spark: SparkSession, folder: str, symbol: str, timeframe: str, start=None, end=None
) -> DataFrame:
    """Bars of one symbol and timeframe by file-name pattern, within inclusive bounds."""
    names = [f"{s}_{mid}" for mid in (f"{timeframe}.csv", f"data_{timeframe}_full_year.csv")
             for s in dict.fromkeys((symbol, symbol.lower()))]
    for n in names:
        try:
            df = read_bar_csv(spark, f"{folder}/{n}", symbol=symbol)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return between(df, start, end).orderBy("ts")
    raise BarFileError(f"no file for {symbol} {timeframe}; tried {names}")


def between(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df


def parse_bar_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``date time open high low close volume`` lines as bars; lines under six tokens are skipped."""
    t = F.split(F.trim(F.col(column)), "\\s+")
    rows = lines.withColumn("_t", t).filter(F.size("_t") >= 6)
    stamp = F.concat_ws(" ", F.col("_t")[0], F.col("_t")[1])
    prices = [
        F.get("_t", F.lit(i + 2)).try_cast("double").alias(c) for i, c in enumerate(OHLCV)
    ]
    keep = [c for c in lines.columns if c != column]
    return rows.select(*keep, F.try_to_timestamp(stamp).alias("ts"), *prices)


def read_bar_lines(spark: SparkSession, path: str, *, symbol: str) -> DataFrame:
    return parse_bar_lines(spark.read.text(path)).select(
        F.lit(symbol).alias("symbol"), "ts", *OHLCV
    )


def write_lines_as_csv(lines: DataFrame, path: str, column: str = "value") -> None:
    parse_bar_lines(lines, column).write.mode("overwrite").csv(path, header=True)


def write_table(
    df: DataFrame,
    path: str,
    *,
    fmt: str = "parquet",
    partition_by: Sequence[str] = ("symbol",),
    order: str | None = "ts",
    mode: str = "overwrite",
) -> None:
    """Feature, label or trade table, partitioned on disk.

    Range partitioning on (partition columns, order) spreads a hot symbol over many files and
    keeps each file's time range narrow, so date filters skip files by their statistics.
    """
    parts = [c for c in partition_by if c in df.columns]
    by = [*parts, *([order] if order and order in df.columns else [])]
    out = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    writer = out.write.mode(mode).partitionBy(*parts) if parts else out.write.mode(mode)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def read_table(
    spark: SparkSession, path: str, *, symbols: Sequence[str] | None = None, start=None, end=None
) -> DataFrame:
    """Bar table with partition pruning on symbol and pushed-down time bounds."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    return between(df, start, end)


def read_trades(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Trade table written as CSV with a header."""
    if schema is not None:
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.csv(path, header=True, inferSchema=True)
