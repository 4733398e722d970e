"""Joins of positions with prices, and unions of entry sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.ordered import null_safe_join, running


def with_latest_price(positions: DataFrame, bars: DataFrame, *, keys=("symbol",), ts="ts", price="close"):
    """Positions with the last known price of their symbol."""
    last = bars.groupBy(*keys).agg(
        F.max_by(price, ts).alias("current_price"), F.max(ts).alias("price_ts")
    )
    return null_safe_join(positions, last, list(keys))


def as_of_price(
    left: DataFrame,
    bars: DataFrame,
    *,
    at: str,
    keys: Sequence[str] = ("symbol",),
    ts="ts",
    price="close",
    out="current_price",
    width: int | str | None = "fit",
) -> DataFrame:
    """Each left row with the last price at or before its time: prices and rows are laid on one
    time line and the latest price is carried along it, bucket by bucket."""
    row = F.struct(*[F.col(c) for c in left.columns])
    none = F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType)
    a = left.select(
        *keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"),
        F.lit(None).cast(bars.schema[price].dataType).alias("_px"),
    )
    b = bars.select(
        *keys, F.col(ts).alias("_t"), F.lit(0).alias("_side"), none.alias("_row"), F.col(price).alias("_px"),
    )
    line = a.unionByName(b)
    pick = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("at"), F.col("_px").alias("v")))
    line = running(line, {"_p": ("max", pick)}, keys=keys, order="_t", ties=["_side"], width=width)
    return line.filter("_side = 1").select("_row.*", F.col("_p.v").alias(out))


def union_entries(sets: Mapping[str, DataFrame], tag: str = "entry_set") -> DataFrame:
    out = None
    for name, df in sets.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def cross_parameters(df: DataFrame, params: DataFrame, limit: int = 100_000) -> DataFrame:
    """Every row with every parameter row; the parameter table is broadcast after a size check."""
    small = params.limit(limit + 1).count() <= limit
    return df.crossJoin(F.broadcast(params) if small else params)
