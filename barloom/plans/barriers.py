"""First touch of a level along the next bars: from bounded forward frames, or for long horizons from
the extremes of chunks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.plans.ordered import null_safe_join, with_position
from barloom.plans.series import Frame, lay_out


def path(f: Frame, cols: Sequence[str], horizon: int, start: int = 1) -> Column:
    """The next bars (rows ``start``..``horizon`` ahead) as an ordered array of structs; the
    memory per row is bounded by the horizon."""
    return F.collect_list(F.struct(*cols)).over(f.rows(start, horizon))


def first_hit(bars: Column, test) -> Column:
    """1-based place of the first bar passing the test, null when none does."""
    at = F.array_position(F.transform(bars, lambda b: F.coalesce(test(b), F.lit(False))), True)
    return F.when(at > 0, at)


def earlier(a: Column, b: Column, tie: bool) -> Column:
    """Whether ``a`` happened before ``b`` (an event that never happened is last)."""
    before = (a <= b) if tie else (a < b)
    return a.isNotNull() & (b.isNull() | before)


@dataclass(frozen=True)
class Touch:
    """The first bar ahead whose ``column`` reaches the row's ``level``: from below (``above``) or from above."""

    column: str
    level: str
    above: bool = True


def first_touches(
    df: DataFrame,
    touches: Mapping[str, Touch],
    horizon: int,
    *,
    start: int = 1,
    keys: Sequence[str] = ("symbol",),
    order: str = "ts",
    ties: Sequence[str] = (),
    width: int | str | None = None,
    step: int | None = None,
) -> DataFrame:
    """Add, for each touch, how many rows ahead (``start`` to ``horizon``) it happens first, or null.

    Made for long horizons: rows are cut into chunks of ``step`` bars (the root of the horizon, unless
    given), each with its highest and lowest values. A row looks through the rest of the chunk where its
    path begins, then through the extremes of the chunks that follow, and opens the one chunk that holds
    the touch. What a row carries grows with the root of the horizon, and no more rows meet a chunk than
    the horizon has.
    """
    keys = list(keys)
    size = step or max(8, math.isqrt(horizon))
    had = "_rn" in df.columns
    rows = df if had else with_position(df, keys=keys, order=order, ties=ties, width=width)
    columns = sorted({t.column for t in touches.values()})
    levels = sorted({t.level for t in touches.values()})
    number = F.floor((F.col("_rn") - 1) / size)
    chunks = rows.groupBy(*keys, number.alias("_chunk")).agg(
        F.array_sort(F.collect_list(F.struct("_rn", *columns))).alias("_bars"),
        *[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("hi", F.max), ("lo", F.min))],
    )
    ahead = math.ceil((horizon - start + 1) / size) + 1
    marks = F.struct("_chunk", *[f"_{n}_{c}" for c in columns for n in ("hi", "lo")])
    laid, frame = lay_out(
        chunks.withColumn("_rn", F.col("_chunk") + 1), back=0, ahead=ahead, keys=keys, order="_chunk"
    )
    laid = laid.withColumn("_next", F.collect_list(marks).over(frame.rows(1, ahead))).filter("_own")
    side = laid.select(*keys, "_chunk", "_bars", "_next")

    slim = rows.select(*keys, "_rn", *levels).withColumn(
        "_chunk", F.floor((F.col("_rn") - 1 + start) / size)
    )
    found = null_safe_join(slim, side, [*keys, "_chunk"])

    def reached(value: Column, t: Touch) -> Column:
        return F.coalesce(value >= F.col(t.level) if t.above else value <= F.col(t.level), F.lit(False))

    def here_of(t: Touch) -> Column:
        return F.filter("_bars", lambda b: (b["_rn"] >= F.col("_rn") + start) & reached(b[t.column], t))

    def there_of(t: Touch) -> Column:
        extreme = f"_{'hi' if t.above else 'lo'}_{t.column}"
        return F.filter("_next", lambda m: reached(m[extreme], t))

    def inside_of(t: Touch) -> Column:
        return F.filter("_bars", lambda b: reached(b[t.column], t))

    near, far = {}, {}
    for name, t in touches.items():
        here, there = here_of(t), there_of(t)
        near[f"_near_{name}"] = F.try_element_at(here, F.lit(1))["_rn"]
        far[f"_far_{name}"] = F.when(
            F.col(f"_near_{name}").isNull(), F.try_element_at(there, F.lit(1))["_chunk"]
        )
    found = found.withColumns(near).withColumns(far)
    asked = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.col(f"_near_{name}").alias("at"), F.col(f"_far_{name}").alias("_chunk"))
            for name in touches
        ]
    )
    asked = found.select(*keys, "_rn", *levels, F.explode(asked).alias("_q")).select(
        *keys, F.col("_rn").alias("_of"), *levels, "_q.name", "_q.at", "_q._chunk"
    )
    known = asked.where("at IS NOT NULL").select(*keys, "_of", "name", "at")
    opened = null_safe_join(
        asked.where("_chunk IS NOT NULL").drop("at"), chunks.select(*keys, "_chunk", "_bars"), [*keys, "_chunk"], "inner"
    )
    at = F.lit(None).cast("bigint")
    for name, t in touches.items():
        at = F.when(F.col("name") == name, F.try_element_at(inside_of(t), F.lit(1))["_rn"]).otherwise(at)
    told = known.unionByName(opened.select(*keys, "_of", "name", at.alias("at")))
    told = told.where(F.col("at") - F.col("_of") <= horizon)
    by_row = told.groupBy(*keys, F.col("_of").alias("_rn")).agg(
        *[F.max(F.when(F.col("name") == n, F.col("at") - F.col("_of"))).alias(n) for n in touches]
    )
    out = null_safe_join(rows.drop(*[n for n in touches if n in rows.columns]), by_row, [*keys, "_rn"])
    return out if had else out.drop("_rn")
