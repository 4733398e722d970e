"""Time-ordered splits and folds from exact row numbers; no data is collected or shuffled randomly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.metrics import split_report
from barloom.plans.ordered import null_safe_join, with_position
from barloom.plans.quantiles import per_key


def numbered(df: DataFrame, *, keys=("symbol",), ts="ts", ties: Sequence[str] = (), width=None) -> DataFrame:
    """Adds the 0-based position ``pos`` and the key's row count ``n``."""
    out = with_position(df, keys=keys, order=ts, ties=ties, width=width, out="pos")
    out = out.withColumn("pos", F.col("pos") - 1)
    return per_key(out, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)


def chronological_split(df, test: float = 0.2, *, keys=("symbol",), ts="ts", out="split", **kw) -> DataFrame:
    """The first floor(n * (1 - test)) rows train, the rest test."""
    d = numbered(df, keys=keys, ts=ts, **kw)
    cut = F.floor(F.col("n") * (1 - test))
    return d.withColumn(out, F.when(F.col("pos") < cut, "train").otherwise("test")).drop("pos", "n")


def split_time(split: DataFrame, *, keys=("symbol",), ts="ts", column="split") -> DataFrame:
    """First time of the test part."""
    return split.filter(F.col(column) == "test").groupBy(*keys).agg(F.min(ts).alias("split_ts"))


def three_way_split(df, train=0.7, val=0.15, *, keys=("symbol",), ts="ts", out="split", **kw) -> DataFrame:
    d = numbered(df, keys=keys, ts=ts, **kw)
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + val))
    part = F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "val").otherwise("test")
    return d.withColumn(out, part).drop("pos", "n")


def validate_split(split: DataFrame, expected: DataFrame, test=0.2, *, keys=("symbol",), ts="ts", label="label", tol=0.05):
    """Sizes, ratio, overlap in time and classes of a train/test split."""
    s = F.col("split")
    agg = split.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(s == "train", 1)).alias("train_rows"),
        F.count(F.when(s == "test", 1)).alias("test_rows"),
        F.max(F.when(s == "train", F.col(ts))).alias("_train_end"),
        F.min(F.when(s == "test", F.col(ts))).alias("_test_start"),
        F.count_distinct(F.when(s == "train", F.col(label))).alias("train_classes"),
        F.count_distinct(F.when(s == "test", F.col(label))).alias("test_classes"),
    )
    want = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_want"))
    out = null_safe_join(agg, want, list(keys))

    def texts(*pairs) -> Column:
        return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]), lambda t: t.isNotNull())

    errors = texts(
        (F.col("rows") != F.col("_want"), "row counts differ"),
        (F.col("_test_start") <= F.col("_train_end"), "test overlaps training"),
        (F.col("train_rows") == 0, "training set is empty"),
        (F.col("test_rows") == 0, "test set is empty"),
    )
    warnings = texts(
        (F.abs(F.col("test_rows") / F.col("rows") - test) > tol, "test ratio differs"),
        (F.col("train_classes") != F.col("test_classes"), "classes differ"),
    )
    out = out.withColumns({"errors": errors, "warnings": warnings})
    return out.withColumn("is_valid", F.size("errors") == 0).drop("_train_end", "_test_start", "_want")


def expanding_folds(df, k: int = 3, *, keys=("symbol",), ts="ts", **kw) -> DataFrame:
    """Rows with their fold and role. Fold i tests one block of floor(n / (k+1)) rows and trains on
    everything before it; a row belongs to at most k folds."""
    d = numbered(df, keys=keys, ts=ts, **kw)
    size = F.floor(F.col("n") / (k + 1))
    roles = []
    for i in range(k):
        end = F.col("n") - size * (k - i)
        role = F.when(F.col("pos") < end, "train").when(F.col("pos") < end + size, "test")
        roles.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    d = d.withColumn("_f", F.explode(F.filter(F.array(*roles), lambda r: r["role"].isNotNull())))
    return d.select(*df.columns, "_f.fold", "_f.role")


def walk_forward_folds(df, k: int = 5, *, keys=("symbol",), ts="ts", **kw) -> DataFrame:
    """Like expanding folds, with the last fifth of each training part set aside for validation."""
    d = numbered(df, keys=keys, ts=ts, **kw)
    size = F.floor(F.col("n") / (k + 1))
    roles = []
    for i in range(k):
        end = size * (i + 1) + (F.col("n") - size * (k + 1))
        val = end - F.floor(end / 5)
        pos = F.col("pos")
        role = (
            F.when(pos < val, "train").when(pos < end, "val").when(pos < F.least(end + size, F.col("n")), "test")
        )
        roles.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    d = d.withColumn("_f", F.explode(F.filter(F.array(*roles), lambda r: r["role"].isNotNull())))
    return d.select(*df.columns, "_f.fold", "_f.role")


def fold_sizes(folds: DataFrame, *, keys=("symbol",), ts="ts") -> DataFrame:
    return folds.groupBy(*keys, "fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("start"), F.max(ts).alias("end")
    )


__all__ = [
    "chronological_split", "expanding_folds", "fold_sizes", "numbered", "split_report", "split_time",
    "three_way_split", "validate_split", "walk_forward_folds",
]
