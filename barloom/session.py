"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume (UTC, AQE, skew joins)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Wide feature plans hold more generated classes than the default cache keeps.
        "spark.sql.codegen.cache.maxEntries": "4000",
        # A block with its halo fits the window buffer without switching to the sorter.
        "spark.sql.windowExec.buffer.in.memory.threshold": "32768",
    }
    base.update(conf)
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()


def set_checkpoint_folder(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder that ``spark.checkpoint.dir`` names. Where it is unset,
    a temporary folder serves a session on one machine; on a cluster that is an error, because
    executors could not read each other's files."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(configured)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so a lost executor costs a re-read. Runs
    the plan at once. Spark removes the files of checkpoints that are no longer referenced where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as ``build_session`` does."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        set_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
