"""Run a stream over files to completion."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files: int = 1) -> DataFrame:
    """Parquet files as a stream, ``files`` per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def closing_mark(rows: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """One row of nulls but for a time so far behind the last that the watermark passes all ``rows``.
    Fed last, it ends a finite stream: what waits for the watermark is told, and the mark itself, which
    no watermark passes, never is. No row for an empty table."""
    end = rows.agg(F.max(ts).alias("_end")).where("_end IS NOT NULL")
    time = F.col("_end") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 SECOND")
    fields = [(time if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]
    return end.select(*fields)


def run_to_table(stream: DataFrame, folder: str) -> list[dict]:
    """Process everything available into parquet files; returns the progress report of every batch,
    gathered while the query runs, since a query itself keeps only its latest ones. Output is
    exactly-once through the checkpoint, and restarts continue from it."""
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    reports: dict[int, dict] = {}

    def gather() -> None:
        for p in q.recentProgress:
            r = json.loads(p.json) if hasattr(p, "json") else dict(p)
            reports[r["batchId"]] = r

    while not q.awaitTermination(0.2):
        gather()
    gather()
    return [reports[k] for k in sorted(reports)]


def run_batches(stream: DataFrame, folder: str, sink) -> None:
    """Hand every micro-batch to ``sink(df, batch_id)``; ids repeat after a failure, so a sink
    that writes under its id stays exactly-once."""
    q = (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def replay(stream: DataFrame, folder: str) -> DataFrame:
    """The stream's whole output as a table."""
    run_to_table(stream, folder)
    schema = stream.schema
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/out")
