"""Summaries of trades and of classifier scores.

Everything is a grouped aggregate with map-side combine. Rank statistics first reduce to one row
per distinct score and then accumulate in score buckets, so no task sorts all predictions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import correlation, div
from barloom.operators.windows import max_drawdown
from barloom.plans.ordered import null_safe_join, running
from barloom.plans.quantiles import exact_quantiles
from barloom.session import durable

SCORE_BINS = 1024


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole with a fixed value for an empty denominator."""
    return F.coalesce(div(part.cast("double"), whole.cast("double")), F.lit(empty))


# ---------------------------------------------------------------------------------- trades


def trade_metrics(
    trades: DataFrame, by: Sequence[str] = (), *, pnl="pnl_pct", held="candles_held", no_loss=float("inf")
) -> DataFrame:
    """Counts, win rate, returns, profit factor, expectancy. ``no_loss`` is the profit factor of a
    group that lost nothing."""
    p, win = F.col(pnl), F.col("win") == 1
    agg = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"),
        count_if(win).alias("winning_trades"),
        count_if(~win).alias("losing_trades"),
        F.sum(p).alias("total_pnl"),
        F.avg(p).alias("avg_pnl"),
        F.avg(F.when(win, p)).alias("avg_win"),
        F.avg(F.when(~win, p)).alias("avg_loss"),
        F.sum(F.when(win, p)).alias("_gross_win"),
        F.abs(F.sum(F.when(~win, p))).alias("_gross_loss"),
        F.avg(held).alias("avg_holding"),
        *([F.avg("pnl_r").alias("avg_r")] if "pnl_r" in trades.columns else []),
    )
    rate = F.col("winning_trades") / F.col("total_trades")
    zero = F.lit(0.0)
    agg = agg.withColumns({"avg_win": F.coalesce("avg_win", zero), "avg_loss": F.coalesce("avg_loss", zero)})
    return agg.withColumns(
        {
            "win_rate": rate * 100,
            "expectancy": rate * F.col("avg_win") + (F.lit(1.0) - rate) * F.col("avg_loss"),
            "profit_factor": F.when(
                F.col("_gross_loss") > 0, F.coalesce("_gross_win", zero) / F.col("_gross_loss")
            ).otherwise(F.lit(no_loss)),
        }
    ).drop("_gross_win", "_gross_loss")


def risk_summary(trades, by=("symbol",), *, order="exit_time", pnl="pnl_pct", ties=()) -> DataFrame:
    """Average R-multiple and deepest drawdown of the running total."""
    r = trades.groupBy(*by).agg(F.avg("pnl_r").alias("avg_r"), F.sum(pnl).alias("total_pnl"))
    return null_safe_join(r, max_drawdown(trades, pnl, keys=by, order=order, ties=ties), list(by))


def breakdown(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and percentage of each value."""
    n = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("_all"))
    out = null_safe_join(n, total, list(by)) if by else n.crossJoin(F.broadcast(total))
    return out.withColumn("pct", F.col("n") * 100.0 / F.col("_all")).drop("_all")


def hourly_rate(df, hit: Column, ts="ts", by: Sequence[str] = (), min_count: int = 0) -> DataFrame:
    """Hits, rows and hit rate per hour of day; hours of at most ``min_count`` rows are left out."""
    out = df.groupBy(*by, F.hour(ts).alias("hour")).agg(
        count_if(hit == 1).alias("wins"), F.count(F.lit(1)).alias("total")
    )
    out = out.withColumn("rate", F.col("wins") * 100.0 / F.col("total"))
    return out.filter(F.col("total") > min_count) if min_count else out


def slices(trades: DataFrame, quick: int = 3, entry_minute: int = 555, by: Sequence[str] = ()) -> DataFrame:
    """Slices that explain losses: quick exits, entries of one minute, stops, longest holdings."""
    minute = F.hour("entry_time") * 60 + F.minute("entry_time")
    conds = {
        "quick_exit": F.col("candles_held") <= quick,
        "open_entry": minute == entry_minute,
        "stop_loss": F.col("exit_reason") == "stop_loss",
        "max_holding": F.col("exit_reason") == "max_holding",
    }
    tags = F.array(*[F.when(v, F.lit(k)) for k, v in conds.items()])
    tagged = trades.withColumn("slice", F.explode(F.filter(tags, lambda t: t.isNotNull())))
    keys = [*by, "slice"]
    agg = tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("win") * 100.0).alias("win_rate"),
        F.avg("pnl_pct").alias("avg_pnl"),
    )
    med = exact_quantiles(tagged, {"candles_held": (0.5,)}, keys=keys)
    out = null_safe_join(agg, med, keys)
    return out.withColumnRenamed("q_candles_held_0", "median_holding")


def compare_runs(runs: Mapping[str, DataFrame], no_loss=float("inf")) -> DataFrame:
    """One row per metric with a column per run and its change against the first run. A run without
    trades counts 0 of them; its other metrics are null."""
    tables = [
        df.select("pnl_pct", "win", "candles_held").withColumn("run", F.lit(n)) for n, df in runs.items()
    ]
    both = tables[0]
    for t in tables[1:]:
        both = both.unionByName(t)
    m = trade_metrics(both, ["run"], no_loss=no_loss)
    names = ["total_trades", "win_rate", "total_pnl", "avg_pnl", "profit_factor", "avg_holding"]
    listed = both.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, runs))).alias("run"))
    m = listed.join(m, "run", "left").fillna(0, ["total_trades"])
    m = m.select("run", *[F.col(n).cast("double").alias(n) for n in names])
    long = m.unpivot(["run"], names, "metric", "value")
    out = long.groupBy("metric").pivot("run", list(runs)).agg(F.first("value"))
    first, *rest = runs
    return out.withColumns({f"{r}_delta": F.col(r) - F.col(first) for r in rest})


def signal_quality(df: DataFrame, flags: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """Per flag: how often it was set and how often each outcome followed, in percent (null for a flag
    that was never set)."""

    def row(flag):
        on = F.col(flag) == 1
        rates = [F.avg(F.when(on, F.col(o) * 100.0)).alias(f"{o}_rate") for o in outcomes]
        return F.struct(F.lit(flag).alias("signal"), count_if(on).alias("n"), *rates)

    return df.agg(F.array(*map(row, flags)).alias("_rows")).select(F.inline("_rows"))


# ---------------------------------------------------------------------------- classification


def confusion(df, label="label", pred="prediction", by: Sequence[str] = (), weight: str | None = None):
    """tn, fp, fn, tp of a binary prediction."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    n = (lambda c: F.sum(F.when(c, F.col(weight)).otherwise(0))) if weight else count_if
    return df.groupBy(*by).agg(
        n(~y & ~p).alias("tn"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(y & p).alias("tp")
    )


def with_scores(conf: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of a confusion row; empty denominators give 0."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    prec, rec = share(tp, tp + fp), share(tp, tp + fn)
    return conf.withColumns(
        {
            "accuracy": share(tp + tn, tp + tn + fp + fn),
            "precision": prec,
            "recall": rec,
            "f1": F.coalesce(div(prec * rec * 2, prec + rec), F.lit(0.0)),
        }
    )


def with_rates(conf: DataFrame) -> DataFrame:
    """Sensitivity, specificity, predictive values and error rates."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return conf.withColumns(
        {
            "sensitivity": share(tp, tp + fn),
            "specificity": share(tn, tn + fp),
            "ppv": share(tp, tp + fp),
            "npv": share(tn, tn + fn),
            "fpr": share(fp, fp + tn),
            "fnr": share(fn, fn + tp),
        }
    )


def _score_counts(df, label, score, by):
    keyed = df.withColumn("_all", F.lit(0)).filter(F.col(score).isNotNull())
    keys = ["_all", *by]
    counts = keyed.groupBy(*keys, F.col(score).cast("double").alias("_s")).agg(
        count_if(F.col(label) == 1).alias("_pos"), count_if(F.col(label) != 1).alias("_neg")
    )
    return counts, keys


def _bucketed(counts: DataFrame) -> tuple[DataFrame, Column]:
    """Distinct scores and the bucket of each: borders are quantiles of the distinct scores, so the
    buckets are even wherever the scores crowd and whatever their range. The counts are written
    once, as they are read three times; ``SCORE_BINS`` numbers come to the driver."""
    counts = durable(counts)
    shares = [i / SCORE_BINS for i in range(1, SCORE_BINS)]
    borders = counts.agg(F.percentile_approx("_s", shares, 10 * SCORE_BINS)).first()[0] or []
    edges = F.lit(sorted(set(borders))) if borders else F.array().cast("array<double>")
    return counts, F.size(F.filter(edges, lambda b: b < F.col("_s"))).cast("long")


def roc_auc(df, label="label", score="probability", by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum form: pairs ranked right, ties count half. Null when a class is missing."""
    counts, keys = _score_counts(df, label, score, by)
    counts, bucket = _bucketed(counts)
    below = running(counts, {"_below": ("sum", F.col("_neg"))}, keys=keys, order="_s", bucket=bucket)
    won = F.col("_pos") * (F.col("_below") - F.col("_neg") / 2.0)
    agg = below.groupBy(*keys).agg(
        F.sum(won).alias("_won"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")
    )
    return agg.select(*by, div(F.col("_won"), F.col("_p") * F.col("_n")).alias("roc_auc"))


def average_precision(df, label="label", score="probability", by: Sequence[str] = ()) -> DataFrame:
    """Precision at each distinct score, weighted by the recall it adds."""
    counts, keys = _score_counts(df, label, score, by)
    counts, bucket = _bucketed(counts)
    cum = running(
        counts,
        {"_tp": ("sum", F.col("_pos"), "back"), "_fp": ("sum", F.col("_neg"), "back")},
        keys=keys,
        order="_s",
        bucket=bucket,
    )
    gain = F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    agg = cum.groupBy(*keys).agg(F.sum(gain).alias("_g"), F.sum("_pos").alias("_p"))
    return agg.select(*by, share(F.col("_g"), F.col("_p")).alias("average_precision"))


def class_report(df, label="label", pred="prediction", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    n = df.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.array(
        F.struct(F.col(label).alias("cls"), F.lit("y").alias("side")),
        F.struct(F.col(pred).alias("cls"), F.lit("p").alias("side")),
    )
    hit = F.col(label) == F.col(pred)
    long = n.select(*by, "_n", hit.alias("_hit"), F.explode(sides).alias("_s"))
    truth, said = F.col("_s.side") == "y", F.col("_s.side") == "p"
    agg = long.groupBy(*by, F.col("_s.cls").alias("class")).agg(
        F.sum(F.when(truth, F.col("_n")).otherwise(0)).alias("support"),
        F.sum(F.when(said, F.col("_n")).otherwise(0)).alias("_said"),
        F.sum(F.when(truth & F.col("_hit"), F.col("_n")).otherwise(0)).alias("_tp"),
    )
    prec, rec = share(F.col("_tp"), F.col("_said")), share(F.col("_tp"), F.col("support"))
    return agg.select(
        *by,
        "class",
        prec.alias("precision"),
        rec.alias("recall"),
        F.coalesce(div(prec * rec * 2, prec + rec), F.lit(0.0)).alias("f1"),
        "support",
    )


def threshold_sweep(
    df, thresholds: Sequence[float], label="label", score="probability", by: Sequence[str] = ()
) -> DataFrame:
    """Confusion and scores at each threshold. Rows first collapse to the threshold interval
    their score falls in, so the sweep multiplies that small table, not the predictions."""
    ts = sorted(thresholds)
    step = sum((F.col(score) >= t).cast("int") for t in ts)
    small = df.groupBy(*by, step.alias("_k"), (F.col(label) == 1).cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("_w")
    )
    grid = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(ts)])
    wide = small.withColumn("_g", F.explode(grid))
    wide = wide.withColumns(
        {"threshold": F.col("_g.t"), "prediction": (F.col("_k") > F.col("_g.i")).cast("int")}
    )
    return with_scores(confusion(wide, by=[*by, "threshold"], weight="_w"))


def best_threshold(sweep: DataFrame, by: Sequence[str] = (), metric="f1") -> DataFrame:
    """Row with the best metric; the lowest threshold among equals."""
    rest = [c for c in sweep.columns if c not in by]
    pick = F.max_by(F.struct(*rest), F.struct(F.col(metric), -F.col("threshold")))
    return sweep.groupBy(*by).agg(pick.alias("_b")).select(*by, "_b.*")


def model_table(df, label="label", pred="prediction", score="probability", model="model") -> DataFrame:
    """One row per model: scores, AUC and average precision."""
    out = with_scores(confusion(df, label, pred, [model]))
    out = null_safe_join(out, roc_auc(df, label, score, [model]), [model])
    return null_safe_join(out, average_precision(df, label, score, [model]), [model])


def split_gap(scores: DataFrame, metrics=("accuracy", "f1"), split="split", by=("model",), limit=0.10):
    """Train less test, and whether it exceeds the limit."""
    wide = scores.groupBy(*by).pivot(split, ["train", "test"]).agg(
        *[F.first(m).alias(m) for m in metrics]
    )
    out = {}
    for m in metrics:
        gap = F.col(f"train_{m}") - F.col(f"test_{m}")
        out[f"{m}_gap"] = gap
        out[f"{m}_overfit"] = gap > limit
    return wide.withColumns(out)


def correlations(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Correlation of every pair of columns, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.groupBy(*by).agg(*[correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def correlated_pairs(df, cols, limit=0.9, by=()) -> DataFrame:
    return correlations(df, cols, by).filter(F.abs("corr") > limit)


def importance_by_category(
    importance: DataFrame, rules: Mapping[str, str], feature="feature", value="importance"
) -> DataFrame:
    """Sum, count and mean importance per name-pattern group; the first matching rule counts."""
    cat = F.lit("other")
    for name, pattern in reversed(list(rules.items())):
        cat = F.when(F.col(feature).rlike(pattern), name).otherwise(cat)
    return importance.groupBy(cat.alias("category")).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("features"), F.avg(value).alias("mean")
    )


def class_weight(df, label="label", by: Sequence[str] = ()) -> DataFrame:
    """Negatives per positive."""
    agg = df.groupBy(*by).agg(
        count_if(F.col(label) == 0).alias("negatives"), count_if(F.col(label) == 1).alias("positives")
    )
    return agg.withColumn("scale_pos_weight", div(F.col("negatives"), F.col("positives")))


def split_report(df, split="split", label="label", ts="ts", by: Sequence[str] = ()) -> DataFrame:
    """Rows, share, class counts and dates of each part of a split."""
    part = df.groupBy(*by, split).agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(F.col(label) == 1).alias("positives"),
        count_if(F.col(label) == 0).alias("negatives"),
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
    )
    total = part.groupBy(*by).agg(F.sum("rows").alias("_all"))
    out = null_safe_join(part, total, list(by)) if by else part.crossJoin(F.broadcast(total))
    return out.withColumn("ratio", F.col("rows") / F.col("_all")).drop("_all")
