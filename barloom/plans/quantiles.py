"""Exact interpolated quantiles per key without holding a key's values in one task.

Where a count shows that every key has at most ``STATE_ROWS`` rows, Spark's own ``percentile``
does it in one pass. Beyond that a bounded sketch brackets each quantile, rows below the bracket
are only counted, and the few values inside it are pre-aggregated and ranked in buckets. Both ways
leave nulls and NaN out, and a key without any value keeps its row, with null quantiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.ordered import null_safe_join, running
from barloom.session import durable

ACCURACY = 10_000
MARGIN = 1e-3
SMALL = 10_000
STATE_ROWS = 1_000_000
BINS = 65_536


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    *,
    keys: Sequence[str] = ("symbol",),
    state_rows: int = STATE_ROWS,
) -> DataFrame:
    """One row per key with a column ``q_<column>_<i>`` per requested probability."""
    keys = list(keys)
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in wanted}
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    if (sizes.agg(F.max("_m")).first()[0] or 0) <= state_rows:
        direct = df.groupBy(*keys).agg(
            *[F.percentile(value[c], list(ps)).alias(f"_q_{c}") for c, ps in wanted.items()]
        )
        return direct.select(
            *keys,
            *[F.col(f"_q_{c}")[i].alias(f"q_{c}_{i}") for c, ps in wanted.items() for i in range(len(ps))],
        )
    pairs = [
        F.struct(F.lit(c).alias("_n"), value[c].alias("_v")) for c in wanted
    ]
    long = df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p._n", "_p._v")
    long = long.filter(F.col("_v").isNotNull())

    probs = sorted({p for ps in wanted.values() for p in ps})
    cuts = [x for p in probs for x in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    stats = long.groupBy(*keys, "_n").agg(
        F.count(F.lit(1)).alias("_cnt"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", cuts, ACCURACY).alias("_cuts"),
    )
    tiny = F.col("_cnt") <= SMALL
    brackets = []
    for i, p in enumerate(probs):
        lo = F.col("_min") if p - MARGIN <= 0 else F.col("_cuts")[2 * i]
        hi = F.col("_max") if p + MARGIN >= 1 else F.col("_cuts")[2 * i + 1]
        users = [c for c, ps in wanted.items() if p in ps]
        b = F.struct(
            F.lit(p).alias("_q"),
            F.when(tiny, F.col("_min")).otherwise(lo).alias("_lo"),
            F.when(tiny, F.col("_max")).otherwise(hi).alias("_hi"),
            F.col("_n").isin(users).alias("_use"),
        )
        brackets.append(b)
    stats = stats.withColumn("_b", F.filter(F.array(*brackets), lambda b: b["_use"]))
    stats = stats.select(*keys, "_n", "_cnt", "_b")

    rows = null_safe_join(long, stats, [*keys, "_n"], "inner")
    rows = rows.select(*keys, "_n", "_cnt", "_v", F.explode("_b").alias("_b"))
    rows = rows.filter(F.col("_v") <= F.col("_b._hi"))
    rows = rows.withColumn("_v", F.when(F.col("_v") >= F.col("_b._lo"), F.col("_v")))
    counts = rows.groupBy(
        *keys,
        "_n",
        "_cnt",
        F.col("_b._q").alias("_q"),
        F.col("_b._lo").alias("_lo"),
        F.col("_b._hi").alias("_hi"),
        "_v",
    ).agg(F.count(F.lit(1)).alias("_m"))
    # Rows below the bracket collapse into one null-valued row, placed before every other.
    width = F.col("_hi") - F.col("_lo")
    spot = F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width * BINS)).otherwise(0)
    counts = counts.withColumn("_at", F.coalesce(F.col("_v"), F.lit(float("-inf"))))
    # Small against the input by now; written once because ranking reads it twice.
    counts = durable(counts)
    ranked = running(
        counts,
        {"_cum": ("sum", F.col("_m"))},
        keys=[*keys, "_n", "_q"],
        order="_at",
        bucket=F.coalesce(spot.cast("long"), F.lit(-1).cast("long")),
    )
    pos = F.col("_q") * (F.col("_cnt") - 1)
    k = F.floor(pos)
    picked = ranked.groupBy(*keys, "_n", "_q").agg(
        F.min(F.when(F.col("_cum") > k, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > k + 1, F.col("_v"))).alias("_b"),
        F.max(pos - k).alias("_frac"),
    )
    found = F.col("_a") + F.col("_frac") * (F.coalesce(F.col("_b"), F.col("_a")) - F.col("_a"))
    cols = [
        F.max(F.when((F.col("_n") == c) & (F.col("_q") == p), found)).alias(f"q_{c}_{i}")
        for c, ps in wanted.items()
        for i, p in enumerate(ps)
    ]
    return null_safe_join(sizes.select(*keys), picked.groupBy(*keys).agg(*cols), keys, "left")


def per_key(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Attach one-row-per-key statistics; AQE broadcasts them if they measure small enough and
    splits hot keys otherwise."""
    return null_safe_join(df, stats, list(keys), "left")
