"""Running aggregates along a series of any length.

A plain ``Window.partitionBy("symbol").orderBy("ts")`` puts a whole symbol into one task. Here
a series is cut into buckets of its order column (a day, by default). Buckets are summed with
map-side combine, their totals are accumulated over two small levels, and only the rows inside
one bucket are sorted together. The widest group any task sees is one bucket of one key, or
``FAN`` bucket totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.plans.clock import DAY_US, is_time, micros

FAN = 1024
HOUR_US = 3_600_000_000
FIT_ROWS = 2_000_000
ID_STEP = 65_536


def bucket_of(df: DataFrame, order: str, width: int | None = None) -> Column:
    """Bucket number of the order column: microseconds for timestamps, units for numbers."""
    if is_time(df, order):
        return F.floor(micros(df, order) / F.lit(width or DAY_US)).cast("long")
    return F.floor(F.col(order) / F.lit(width or ID_STEP)).cast("long")


def fit_width(df: DataFrame, keys: Sequence[str], order: str, limit: int = FIT_ROWS) -> int:
    """Bucket width at which no (key, bucket) holds more than ``limit`` rows: for ticks and other
    tables whose rows per day have no natural bound. Counts two columns, once per refinement;
    rows of one key at one and the same instant cannot be split further."""
    time = is_time(df, order)
    width, floor = (DAY_US, 1000) if time else (ID_STEP, 1)
    while width > floor:
        n = df.groupBy(*keys, bucket_of(df, order, width).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        most = n.agg(F.max("_n")).first()[0] or 0
        if most <= limit:
            break
        width = max(floor, int(width * limit / most / 2))
    return width


def _both(a: Column, b: Column, kind: str) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(a + b, a, b)
    return F.coalesce(F.greatest(a, b) if kind == "max" else F.least(a, b), a, b)


def _struct_pick(a: Column, b: Column, kind: str) -> Column:
    newer = (a > b) if kind == "max" else (a < b)
    return F.when(a.isNull(), b).when(b.isNull(), a).when(newer, a).otherwise(b)


_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    specs: Mapping[str, tuple],
    *,
    keys: Sequence[str] = ("symbol",),
    order: str = "ts",
    ties: Sequence[str] = (),
    width: int | str | None = None,
    bucket: Column | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Add running sum / count / max / min columns over each key's whole history.

    ``specs`` maps an output name to ``(kind, column)`` or ``(kind, column, "back")``; the latter
    runs from the end. Struct-valued max and min carry a value along with its position, which is
    how the last or next non-null value is found. With ``exclusive`` the row itself is left out.
    ``bucket`` replaces the default bucket number by an expression of bounded range. The input is
    read twice: once for the totals (only the columns they need), once for the rows. ``width`` is
    a bucket width, or ``"fit"`` to choose it from the data.
    """
    keys = list(keys)
    if width == "fit":
        width = fit_width(df, keys, order)
    names = list(specs)
    kind = {n: specs[n][0] for n in names}
    back = {n: len(specs[n]) > 2 and specs[n][2] == "back" for n in names}
    data = df.withColumn("_b0", bucket if bucket is not None else bucket_of(df, order, width))
    data = data.withColumns({f"_v_{n}": specs[n][1] for n in names})
    nested = {
        n: isinstance(data.schema[f"_v_{n}"].dataType, (T.StructType, T.ArrayType)) for n in names
    }

    def joined(n, a, b):
        return _struct_pick(a, b, kind[n]) if nested[n] else _both(a, b, kind[n])

    def merged_before(n, prefix, part, level):
        order_by = F.col(level).desc() if back[n] else F.col(level).asc()
        w = Window.partitionBy(*part).orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
        return _MERGE[kind[n]](f"{prefix}{n}").over(w)

    many = bucket is None and not (is_time(df, order) and (width or DAY_US) >= HOUR_US)
    if many:
        data = data.withColumn("_b1", F.floor(F.col("_b0") / FAN))
    fine = data.groupBy(*keys, *(["_b1"] if many else []), "_b0").agg(
        *[_AGG[kind[n]](f"_v_{n}").alias(f"_t_{n}") for n in names]
    )
    inner = [*keys, "_b1"] if many else keys
    off = {f"_off_{n}": merged_before(n, "_t_", inner, "_b0") for n in names}
    if many:
        coarse = fine.groupBy(*keys, "_b1").agg(
            *[_MERGE[kind[n]](f"_t_{n}").alias(f"_c_{n}") for n in names]
        )
        coarse = coarse.select(
            *keys,
            "_b1",
            *[merged_before(n, "_c_", keys, "_b1").alias(f"_o1_{n}") for n in names],
        )
        fine = null_safe_join(fine.withColumns(off), coarse, inner)
        off = {f"_off_{n}": joined(n, F.col(f"_o1_{n}"), F.col(f"_off_{n}")) for n in names}
    # The offsets travel as one extra row per bucket: rows and offsets meet in the window's own
    # shuffle, where a join would move the rows a second time.
    marks = fine.withColumns(off).select(*keys, "_b0", *off, F.lit(True).alias("_mark"))
    data = data.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)

    def window(n):
        cols = [F.col(c).desc() if back[n] else F.col(c).asc() for c in (order, *ties)]
        return Window.partitionBy(*keys, "_b0").orderBy(*cols)

    everything = (Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = (Window.unboundedPreceding, -1 if exclusive else 0)
    parts = {}
    for n in names:
        parts[f"_r_{n}"] = _AGG[kind[n]](f"_v_{n}").over(window(n).rowsBetween(*so_far))
        parts[f"_off_{n}"] = F.max(f"_off_{n}").over(window(n).rowsBetween(*everything))
    data = data.withColumns(parts).filter(~F.col("_mark"))
    data = data.withColumns({n: joined(n, F.col(f"_off_{n}"), F.col(f"_r_{n}")) for n in names})
    kept = [c for c in df.columns if c not in specs]
    return data.select(*kept, *names)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how="left") -> DataFrame:
    """Equi join on columns that may be null, keeping the left copies."""
    r = right.select(*[F.col(c).alias(f"_j_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in on]
    )
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_j_{c}" for c in on])


def with_position(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    order: str = "ts",
    ties: Sequence[str] = (),
    width: int | None = None,
    out: str = "_rn",
) -> DataFrame:
    """Exact 1-based row number of each row within its key."""
    return running(
        df, {out: ("count", F.lit(1))}, keys=keys, order=order, ties=ties, width=width
    )


def last_known(
    df: DataFrame,
    last: Mapping[str, str],
    following: Mapping[str, str] | None = None,
    *,
    position: str = "ts",
    keys: Sequence[str] = ("symbol",),
    order: str = "ts",
    ties: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Add ``struct(at, v)`` of the latest non-null value of each column, this row included, and
    of the next one for the columns in ``following``.

    Both map the output name to the source column; ``at`` is the ``position`` column.
    """

    def known(c):
        pair = F.struct(F.col(position).alias("at"), F.col(c).alias("v"))
        return F.when(F.col(c).isNotNull(), pair)

    specs = {out: ("max", known(c)) for out, c in last.items()}
    specs.update({out: ("min", known(c), "back") for out, c in (following or {}).items()})
    return running(df, specs, keys=keys, order=order, ties=ties, width=width)
