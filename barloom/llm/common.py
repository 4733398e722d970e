"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import set_checkpoint_folder

_WORKER: dict[Any, Any] = {}


#: Objects that one stage uses side by side; a worker drops those of other stages.
_TOGETHER = {"encoder": "bpe", "decoder": "bpe"}


def per_worker(key: Any, make: Callable[[], Any]) -> Any:
    """One object per Python worker and key; a newer key of the same kind replaces the older, and
    what an earlier stage left in the worker goes."""
    kind, ident = key
    held = _WORKER.get(kind)
    if held is None or held[0] != ident:
        stage = _TOGETHER.get(kind, kind)
        others = [k for k in _WORKER if _TOGETHER.get(k, k) != stage]
        for other in others:
            del _WORKER[other]
        if others:
            give_back()
        held = _WORKER[kind] = [ident, make(), None]
        trim()  # what only the making needed
    held[2] = _stage()
    return held[1]


def _stage() -> int | None:
    task = TaskContext.get()
    return None if task is None else task.stageId()


def let_go() -> None:
    """For work that keeps nothing itself: drop what earlier stages left in this worker."""
    if not _WORKER:
        return
    now = _stage()
    others = [k for k, held in _WORKER.items() if held[2] != now]
    for other in others:
        del _WORKER[other]
    if others:
        give_back()


def give_back() -> None:
    """Hand freed memory back to the system: a worker outlives its stage, and shares its executor."""
    gc.collect()
    trim()


def trim() -> None:
    """Hand back what is free already, without looking for cycles: cheap enough for every slice."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name in df.columns:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: Bytes of one Arrow batch of texts. Workers hold a batch, its results and their tables.
BATCH = 8 << 20


def small_batches(spark: SparkSession, size: int = BATCH) -> None:
    """Lower the session's Arrow batches to ``size`` bytes where they are larger: texts can be long,
    and the Python workers and the JVM share an executor's memory. Spark hands tasks to its idle workers
    in turn, so that more workers than cores may hold tables."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not digits or int(digits[1]) > size:
        spark.conf.set(name, str(size))


def in_slices(
    fn: Callable[..., pa.Array], rows: int = 256, after: Callable[[], None] | None = None
) -> Callable[..., pa.Array]:
    """An Arrow function applied to a few rows at a time, so that a batch of large texts is never
    held as Python objects whole; ``after`` is called behind each slice."""

    def run(*arrays: pa.Array) -> pa.Array:
        n = len(arrays[0])
        parts = []
        for i in range(0, n, rows):
            parts.append(fn(*(a.slice(i, rows) for a in arrays)))
            if after:
                after()
        return pa.concat_arrays(parts) if parts else fn(*arrays)

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run(a, b, c)

    return (one, two, three)[fn.__code__.co_argcount - 1]  # a plain signature tells Spark the kind


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole key groups from batches sorted by ``key``: each table holds complete groups.

    A group may span batches; only the unfinished last group is carried over.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        last = keys[batch.num_rows - 1]
        if keys[0] == last and kept and kept[-1].column(key)[-1] == last:
            kept.append(batch)
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1], side="left")) if np.all(
            values[:-1] <= values[1:]
        ) else batch.num_rows - int(np.argmax(values[::-1] != values[-1]))
        if values[0] == values[-1]:
            cut = 0
        if kept or cut:
            whole = [*kept, batch.slice(0, cut)] if cut else kept
            yield pa.Table.from_batches(whole)
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept)


def bounds(values: np.ndarray) -> np.ndarray:
    """Start of every run of equal neighbours, and the end."""
    if not len(values):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit integers (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as checkpoints use it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        set_checkpoint_folder(spark)
    return str(sc.getCheckpointDir())
