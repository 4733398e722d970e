"""Interleave sources to target weights by Pfair scheduling.

Each source's rows, in a seeded random order, are cut into blocks. Block ``i`` (from 1) of a source
of weight ``w`` may run from slot ``floor((i-1)/w)`` on and must have run before slot ``ceil(i/w)``.
Earliest deadline first among the released blocks meets every deadline, so at every slot each
source is less than one block away from its weight.

Weights are whole shares of a frame of ``frame`` slots; then the schedule repeats after each frame,
so only one frame (``frame`` rows, a parameter) is worked out and any block's slot follows by
arithmetic: no global simulation, whatever the number of blocks. Rows are numbered within a source by
buckets of a hash: bucket counts combine on the map side and no source meets in one task.

Every row is kept exactly once. Where a source has run out its slots stay empty, and the others go
on in proportion to their weights.

Defined cases: a null source is a source of its own; a source without a weight is an error when
weights are given by hand; rows that repeat id and text are numbered in any order among themselves;
an empty table gives no rows. Other columns stay; names of the added columns can be chosen.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = 1000
BLOCK_ROWS = 16
#: Rows of one bucket of the numbering, about.
BUCKET_ROWS = 256


def whole_shares(weights: Mapping[str, float], frame: int) -> dict[str, int]:
    """Weights as whole numbers of slots that add up to the frame, at least one each: the largest
    remainders are rounded up."""
    if not weights:
        return {}
    if len(weights) > frame:
        raise ValueError("more sources than slots in a frame")
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    total = sum(weights.values())
    exact = {s: max(1.0, w / total * frame) for s, w in weights.items()}
    share = {s: int(x) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (share[s] - exact[s], s))
    for s in order[: max(0, frame - sum(share.values()))]:
        share[s] += 1
    while sum(share.values()) != frame:  # what the least share of one took is given by the largest
        big = max(share, key=lambda s: (share[s], s))
        share[big] += 1 if sum(share.values()) < frame else -1
    return share


def frame_slots(share: Mapping[str, int], frame: int) -> list[tuple[str, int, int]]:
    """One frame: (source, its k-th block from 0, slot), by earliest deadline among released blocks.
    Ties go to the source that comes first by name."""
    waiting = [(0, s, 0) for s in share]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(frame):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * frame // share[s]), s, k))
        due, s, k = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append((s, k, slot))
        if k + 1 < share[s]:
            heapq.heappush(waiting, ((k + 1) * frame // share[s], s, k + 1))
    return out


def shuffle_key(key: str, seed: int) -> Column:
    """Seeded random order of rows that any engine reproduces."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def numbered(df: DataFrame, source: str, key: str, seed: int) -> DataFrame:
    """Add ``_seq``: the row's number from 0 within its source, in the seeded order."""
    h = shuffle_key(key, seed)
    ordered = df.withColumn("__mix_h", h).withColumn("__mix_src", F.col(source))
    hex_digits = 8
    place = F.conv(F.substring("__mix_h", 1, hex_digits), 16, 10).cast("bigint")
    # Finer buckets for larger tables; the numbers come out the same.
    n = df.count()
    n_buckets = max(1, n // BUCKET_ROWS)
    ordered = ordered.withColumn("__mix_b", F.floor(place * F.lit(n_buckets) / F.lit(16**hex_digits)).cast("bigint"))
    counts = ordered.groupBy("__mix_src", "__mix_b").agg(F.count("*").alias("__mix_n"))
    # Offsets in two levels, so that the buckets of one source do not meet in one task either.
    coarse = F.floor(F.col("__mix_b") / 1024)
    w_in = Window.partitionBy("__mix_src", "__mix_g").orderBy("__mix_b").rowsBetween(Window.unboundedPreceding, -1)
    w_up = Window.partitionBy("__mix_src").orderBy("__mix_g").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__mix_g", coarse)
    upper = counts.groupBy("__mix_src", "__mix_g").agg(F.sum("__mix_n").alias("__mix_t"))
    upper = upper.select(
        F.col("__mix_src").alias("__mix_us"), F.col("__mix_g").alias("__mix_ug"), F.coalesce(F.sum("__mix_t").over(w_up), F.lit(0)).alias("__mix_up")
    )
    inner = counts.withColumn("__mix_in", F.coalesce(F.sum("__mix_n").over(w_in), F.lit(0)))
    offsets = inner.join(
        upper, inner["__mix_src"].eqNullSafe(upper["__mix_us"]) & (inner["__mix_g"] == upper["__mix_ug"])
    ).select(F.col("__mix_src").alias("__mix_os"), F.col("__mix_b").alias("__mix_ob"), (F.col("__mix_in") + F.col("__mix_up")).alias("__mix_off"))
    rows = ordered.join(
        offsets, ordered["__mix_src"].eqNullSafe(offsets["__mix_os"]) & (ordered["__mix_b"] == offsets["__mix_ob"])
    )
    w = Window.partitionBy("__mix_src", "__mix_b").orderBy("__mix_h", F.col(key))
    return rows.withColumn("__mix_seq", F.col("__mix_off") + F.row_number().over(w) - 1).drop(
        "__mix_h", "__mix_b", "__mix_os", "__mix_ob", "__mix_off", "__mix_src"
    )


def tempered(df: DataFrame, source: str, temperature: float) -> dict[str | None, float]:
    """Weights by the share of rows to the power ``1 / temperature``: one row per source comes to
    the driver; more sources than slots of a frame are refused before they are fetched."""
    counts = df.groupBy(source).agg(F.count("*").alias("n"))
    rows = counts.limit(FRAME + 1).collect()
    if len(rows) > FRAME:
        raise ValueError("more sources than slots in a frame: give coarser sources")
    return {r[0]: r.n ** (1.0 / temperature) for r in rows}


_NULL = "\0null"


def mix(
    df: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    source: str = "source",
    key: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    frame: int = FRAME,
    temperature: float = 2.0,
    seed: int = 17,
    into: str = "mix",
) -> DataFrame:
    """Add a struct ``into``: ``block`` (number within the source, from 0), ``row`` (within the
    block), ``slot``, ``release`` and ``deadline``. Ordering by slot and row gives the mix. Without
    ``weights`` they are the tempered shares of the sources."""
    given = tempered(df, source, temperature) if weights is None else dict(weights)
    share = whole_shares({_NULL if s is None else s: w for s, w in given.items()}, frame)
    spark = df.sparkSession
    plan = spark.createDataFrame(
        [(s, share[s], k, slot) for s, k, slot in frame_slots(share, frame)] if share else [],
        "__mix_ps string, __mix_share bigint, __mix_pk bigint, __mix_ofs bigint",
    )
    rows = numbered(df, source, key, seed)
    block = F.floor(F.col("__mix_seq") / block_rows).cast("bigint")
    named = F.coalesce(F.col(source), F.lit(_NULL))
    shares = spark.createDataFrame(list(share.items()), "__mix_ss string, __mix_k bigint")
    placed = (
        rows.withColumn("__mix_blk", block)
        .withColumn("__mix_name", named)
        .join(F.broadcast(shares), F.col("__mix_name") == F.col("__mix_ss"), "left")
        .withColumn(
            "__mix_k",
            F.when(F.col("__mix_k").isNull(), F.raise_error(F.concat(F.lit("no weight for source "), "__mix_name"))).otherwise(
                F.col("__mix_k")
            ),
        )
        .withColumn("__mix_pk0", F.col("__mix_blk") % F.col("__mix_k"))
        # The frame has a fixed number of rows.
        .join(F.broadcast(plan), (F.col("__mix_name") == F.col("__mix_ps")) & (F.col("__mix_pk0") == F.col("__mix_pk")))
    )
    n = F.col("__mix_blk")
    return placed.select(
        *[F.col(f"`{c}`") for c in df.columns if c != into],
        F.struct(
            n.alias("block"),
            (F.col("__mix_seq") % block_rows).alias("row"),
            (F.floor(n / F.col("__mix_k")) * frame + F.col("__mix_ofs")).alias("slot"),
            F.floor(n * frame / F.col("__mix_k")).alias("release"),
            F.ceil((n + 1) * frame / F.col("__mix_k")).alias("deadline"),
        ).alias(into),
    )


def mix_sql(table: str = "documents", frame: int = FRAME, block_rows: int = BLOCK_ROWS, seed: int = 17) -> str:
    """The mix of tempered weights (temperature 2) in plain SQL: one frame by recursion, then
    arithmetic. It holds while every share is above one slot of the frame."""
    return f"""
WITH RECURSIVE c AS (SELECT coalesce(source, chr(0) || 'null') AS s, sqrt(count(*)) AS w FROM {table} GROUP BY 1),
e AS (SELECT s, w / sum(w) OVER () * {frame} AS x FROM c),
f AS (SELECT s, CAST(floor(x) AS BIGINT) AS k, row_number() OVER (ORDER BY floor(x) - x, s) AS r,
      {frame} - sum(floor(x)) OVER () AS rest FROM e),
sh AS (SELECT s, k + CASE WHEN r <= rest THEN 1 ELSE 0 END AS k, row_number() OVER (ORDER BY s) AS i FROM f),
ks AS (SELECT list(k ORDER BY i) AS k FROM sh),
edf AS (
  SELECT 0 AS slot, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS b, [CAST(0 AS BIGINT) FOR x IN k] AS done, k FROM ks
  UNION ALL
  SELECT slot + 1, pick, done[pick], [done[j] + CASE WHEN j = pick THEN 1 ELSE 0 END FOR j IN range(1, len(k) + 1)], k
  FROM (SELECT *, list_min([CASE WHEN done[j] < k[j] AND done[j] * {frame} // k[j] <= slot
          THEN ((done[j] + 1) * {frame} + k[j] - 1) // k[j] * 100000 + j ELSE 1000000000000 END
          FOR j IN range(1, len(k) + 1)]) % 100000 AS pick FROM edf)
  WHERE slot < {frame}),
plan AS (SELECT sh.s, sh.k, edf.b, edf.slot - 1 AS ofs FROM edf JOIN sh USING (i)),
d AS (SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS s,
        row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{seed}'), doc_id) - 1 AS seq
      FROM {table}),
b AS (SELECT d.*, seq // {block_rows} AS block, sh.k FROM d JOIN sh USING (s))
SELECT b.doc_id, b.source, b.block, b.seq % {block_rows} AS row, b.block // b.k * {frame} + p.ofs AS slot,
       b.block * {frame} // b.k AS release, ((b.block + 1) * {frame} + b.k - 1) // b.k AS deadline
FROM b JOIN plan p ON p.s = b.s AND p.b = b.block % b.k"""
