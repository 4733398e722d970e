"""Top rows and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, n: int, by: str, *, largest: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The n best rows: each task keeps n, the driver-side merge keeps n."""
    first = F.col(by).desc() if largest else F.col(by).asc()
    return df.orderBy(first, *[F.col(t).asc() for t in ties]).limit(n)


def best_and_worst(trades: DataFrame, n: int = 5, by="pnl_pct", ties: Sequence[str] = ()) -> DataFrame:
    best = top_n(trades, n, by, ties=ties).withColumn("side", F.lit("best"))
    worst = top_n(trades, n, by, largest=False, ties=ties).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def top_configs(
    results: DataFrame, metrics: Sequence[str], n: int = 10, *, key="config_id", min_trades: int = 0
) -> DataFrame:
    """The n best configurations by each metric, ranked. One top-n per metric, so the table of
    results is never sorted as a whole."""
    if min_trades:
        results = results.filter(F.col("total_trades") >= min_trades)
    out = None
    for m in metrics:
        best = top_n(results, n, m, ties=[key])
        # n rows are left: ranking them takes one small window.
        rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.col(m).desc(), key))
        best = best.withColumn("metric", F.lit(m)).withColumn("rank", rank)
        best = best.withColumn("value", F.col(m).cast("double")).select("metric", "rank", key, "value")
        out = best if out is None else out.unionByName(best)
    return out


# Weights of the balanced score.
BALANCED = {"total_pnl": 0.4, "profit_factor": 3.0, "win_rate": 0.3}


def balanced_score(weights: Mapping[str, float] = BALANCED) -> Column:
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))


def best_balanced(results: DataFrame, weights: Mapping[str, float] = BALANCED, key="config_id") -> DataFrame:
    return top_n(results.withColumn("score", balanced_score(weights)), 1, "score", ties=[key])


def rank_features(importance: DataFrame, n: int | None = None, value="importance", name="feature") -> DataFrame:
    """Features by importance with their share and cumulative share. The table has one row per
    feature of a model, so its windows are small by definition."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(value).desc(), name)
    total = F.sum(value).over(Window.partitionBy(F.lit(0)))
    run = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = importance.withColumns(
        {
            "rank": F.row_number().over(w),
            "share": F.col(value) / total,
            "cumulative_share": run / total,
        }
    )
    return out.filter(F.col("rank") <= n) if n else out


def sorted_by_time(df: DataFrame, *, keys=("symbol",), ts="ts", ties: Sequence[str] = ()) -> DataFrame:
    """Global order by range partitioning; ties keep ingest order."""
    return df.orderBy(*keys, ts, *ties)
