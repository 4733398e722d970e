"""Bars, duplicates, late rows, sessions and checks on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schema import PRICES
from barloom.sources.ticks import ticks_to_bars


def stream_bars(
    ticks: DataFrame, every="1 hour", *, delay="10 minutes", slide=None, value="value", ts="ts", keys=("symbol",)
) -> DataFrame:
    """Bars that are emitted once the watermark has passed them; later ticks are dropped."""
    return ticks_to_bars(
        ticks.withWatermark(ts, delay), every, value=value, ts=ts, keys=keys, slide=slide
    )


def stream_bars_in_time(
    ticks: DataFrame, every="1 hour", *, delay="10 minutes", value="value", ts="ts", keys=("symbol",)
) -> DataFrame:
    """The same bars with their event time (``closed``, the last instant of the bar), for stateful
    operators further down the same stream."""
    return ticks_to_bars(ticks.withWatermark(ts, delay), every, value=value, ts=ts, keys=keys, time="closed")


def late_sink(folder: str, every: str, *, delay="10 minutes", ts="ts"):
    """Sink that keeps the rows which ``stream_bars`` leaves out as too late: those whose bar the
    watermark of the batches before has passed. Rows go to ``folder/rows``; the latest time of each
    batch lies beside them under its id, so a repeated batch tells the same."""

    def sink(rows: DataFrame, batch_id: int) -> None:
        spark, marks = rows.sparkSession, f"{folder}/marks"
        latest = rows.agg(F.max(ts).alias("latest"))
        if batch_id:
            before = spark.read.schema("latest timestamp, batch int").parquet(marks)
            mark = before.where(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
            limit = F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {delay}")
            late = rows.where(F.window(ts, every)["end"] <= limit)
        else:
            late = rows.where(F.lit(False))
        late.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        latest.write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    return sink


def stream_dedup(rows: DataFrame, *, keys=("symbol",), ts="ts", delay="10 minutes") -> DataFrame:
    """First row of each (key, time); state is dropped with the watermark."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def stream_sessions(
    rows: DataFrame, gap="6 hours", *, keys=("symbol",), ts="ts", value="value", delay="10 minutes"
) -> DataFrame:
    """Activity sessions closed by a gap."""
    s = rows.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("_s"))
    return s.agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total")).select(
        *keys, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), "rows", "total"
    )


def stream_days(rows: DataFrame, *, keys=("symbol",), ts="ts", value="value", delay="10 minutes") -> DataFrame:
    """One row per trading day, emitted when the day is over."""
    d = rows.withWatermark(ts, delay).groupBy(*keys, F.window(ts, "1 day").alias("_d"))
    return d.agg(
        F.count(F.lit(1)).alias("rows"), F.max_by(value, ts).alias("last")
    ).select(*keys, F.col("_d.start").alias("day"), "rows", "last")


def bad_bars(bars: DataFrame) -> DataFrame:
    """Bars breaking price logic, with the reasons; stateless, so it runs on streams as it is."""
    checks = F.array(
        F.when(F.col("high") < F.greatest("open", "close"), F.lit("high below open or close")),
        F.when(F.col("low") > F.least("open", "close"), F.lit("low above open or close")),
        F.when(F.col("high") < F.col("low"), F.lit("high below low")),
        *[F.when(F.col(c) <= 0, F.lit(f"{c} not positive")) for c in PRICES],
        F.when(F.col("volume") < 0, F.lit("negative volume")),
    )
    out = bars.withColumn("issues", F.filter(checks, lambda c: c.isNotNull()))
    return out.filter(F.size("issues") > 0)


def dropped_late_rows(progress: Sequence[dict]) -> int:
    """Rows the watermark dropped, from a query's progress reports."""
    return sum(
        int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", [])
    )
