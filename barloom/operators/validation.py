"""Checks of bar tables as aggregates: one row per key, or a list of offending rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.cleaning import outlier_rows
from barloom.plans.clock import micros
from barloom.plans.ordered import null_safe_join
from barloom.plans.quantiles import exact_quantiles, per_key
from barloom.plans.series import columns_step, over_series
from barloom.schema import OHLCV, PRICES

# Default limits.
MIN_ROWS = 100
MAX_MISSING = 0.05
MAX_MOVE = 0.20


def count_if(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def _joined(parts: list[DataFrame], keys) -> DataFrame:
    return reduce(lambda a, b: null_safe_join(a, b, list(keys)), parts)


def completeness(df, *, keys=("symbol",), min_rows=MIN_ROWS, max_missing=MAX_MISSING) -> DataFrame:
    """Row count, worst missing share, and whether both pass."""
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[(count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(f"missing_{c}") for c in OHLCV],
    )
    worst = F.greatest(*[F.col(f"missing_{c}") for c in OHLCV])
    return agg.withColumn(
        "is_complete", (F.col("rows") >= min_rows) & (worst <= max_missing)
    )


def missing_profile(df, *, keys=("symbol",), max_missing=MAX_MISSING) -> DataFrame:
    """Per column: missing count, percentage and severity."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *[count_if(F.col(c).isNull()).alias(c) for c in OHLCV]
    )
    long = counts.unpivot([*keys, "rows"], list(OHLCV), "column", "missing")
    pct = F.col("missing") / F.col("rows") * 100
    level = (
        F.when(pct > max_missing * 100, "error").when(F.col("missing") > 0, "warning").otherwise("ok")
    )
    return long.select(*keys, "column", "missing", pct.alias("missing_pct"), level.alias("severity"))


def _ohlc_aggs() -> list[Column]:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return [
        count_if(F.col("high") < top).alias("high_violations"),
        count_if(F.col("low") > bottom).alias("low_violations"),
        count_if(F.col("high") < F.col("low")).alias("high_low_violations"),
        *[count_if(F.col(c) <= 0).alias(f"non_positive_{c}") for c in PRICES],
    ]


def ohlc_violations(df, *, keys=("symbol",)) -> DataFrame:
    return df.groupBy(*keys).agg(*_ohlc_aggs())


def _steps(df, keys, ts, width=None) -> DataFrame:
    """Bars with the move and the seconds since the previous bar."""
    df = df.withColumn("_us", micros(df, ts))
    step = columns_step(
        lambda f: {
            "move": F.abs(F.try_divide(F.col("close"), f.lag("close")) - 1),
            "gap_s": (F.col("_us") - f.lag("_us")) / 1_000_000,
            "prev_ts": f.lag(ts),
        },
        back=1,
    )
    return over_series(df, step, keys=keys, order=ts, width=width)


def extreme_moves(df, *, keys=("symbol",), ts="ts", limit=MAX_MOVE) -> DataFrame:
    s = _steps(df, keys, ts)
    return s.groupBy(*keys).agg(
        count_if(F.col("move") > limit).alias("extreme_moves"),
        F.max("move").alias("max_move"),
    )


def _volume_aggs() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        count_if(F.col("volume") < 0).alias("negative_volume"),
        count_if(F.col("volume") == 0).alias("zero_volume"),
    ]


def volume_checks(df, *, keys=("symbol",), spread=100.0) -> DataFrame:
    """Negative and zero volumes, and volumes above q99 where q99 exceeds ``spread`` medians."""
    q = exact_quantiles(df, {"volume": (0.5, 0.99)}, keys=keys)
    rows = per_key(df, q, keys)
    wild = (F.col("q_volume_1") > F.col("q_volume_0") * spread) & (
        F.col("volume") > F.col("q_volume_1")
    )
    agg = rows.groupBy(*keys).agg(
        *_volume_aggs(),
        F.first("q_volume_0").alias("volume_q50"),
        F.first("q_volume_1").alias("volume_q99"),
        count_if(wild).alias("erroneous_high"),
    )
    share = F.col("zero_volume") / F.col("rows")
    return agg.withColumns(
        {
            "zero_share": share,
            "zero_error": share > 0.1,
            "zero_warning": share > 0.05,
        }
    )


def duplicate_times(df, *, keys=("symbol",), ts="ts") -> DataFrame:
    """Repeats beyond the first of each (key, time); two-phase, so hot times combine map-side."""
    per = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg((F.sum("_n") - F.count(F.lit(1))).alias("duplicates"))


def chronological_order(df, *, keys=("symbol",), ts="ts", ingest="ingest_id") -> DataFrame:
    """Rows whose time lies before that of the row ingested just before them."""
    step = columns_step(lambda f: {"_back": f.lag(ts) > F.col(ts)}, back=1)
    s = over_series(df.select(*keys, ts, ingest), step, keys=keys, order=ingest)
    return s.groupBy(*keys).agg(count_if(F.col("_back")).alias("out_of_order")).withColumn(
        "is_ordered", F.col("out_of_order") == 0
    )


def large_gaps(df, *, keys=("symbol",), ts="ts", factor=10.0, width=None) -> DataFrame:
    """Gaps longer than ``factor`` median gaps."""
    s = _steps(df, keys, ts, width).filter(F.col("gap_s").isNotNull()).select(*keys, "gap_s")
    s = per_key(s, exact_quantiles(s, {"gap_s": (0.5,)}, keys=keys), keys)
    return s.groupBy(*keys).agg(
        F.first("q_gap_s_0").alias("median_gap_s"),
        count_if(F.col("gap_s") > F.col("q_gap_s_0") * factor).alias("large_gaps"),
    )


def gap_list(df, expected_s: float, *, keys=("symbol",), ts="ts", factor=1.5) -> DataFrame:
    """Every gap longer than ``factor`` expected steps."""
    s = _steps(df, keys, ts)
    return s.filter(F.col("gap_s") > factor * expected_s).select(
        *keys, F.col("prev_ts").alias("gap_start"), F.col(ts).alias("gap_end"), "gap_s"
    )


def largest_gap(df, expected_s: float, *, keys=("symbol",), ts="ts") -> DataFrame:
    return gap_list(df, expected_s, keys=keys, ts=ts).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("gaps"), F.max("gap_s").alias("largest_gap_s")
    )


def _long_prices(df, keys):
    return df.select(*keys, *PRICES).unpivot(list(keys), list(PRICES), "column", "value")


def repeated_share(df, *, keys=("symbol",), limit=10.0) -> DataFrame:
    """Share of the most frequent value of each price column."""
    per = _long_prices(df, keys).groupBy(*keys, "column", "value").agg(
        F.count(F.lit(1)).alias("_n")
    )
    agg = per.groupBy(*keys, "column").agg(
        (F.max(F.when(F.col("value").isNotNull(), F.col("_n"))) / F.sum("_n") * 100).alias(
            "repeated_pct"
        )
    )
    return agg.withColumn("is_repeated", F.col("repeated_pct") > limit)


def uniqueness(df, *, keys=("symbol",), limit=50.0) -> DataFrame:
    """Share of distinct values of each price column."""
    per = _long_prices(df, keys).groupBy(*keys, "column", "value").agg(
        F.count(F.lit(1)).alias("_n")
    )
    agg = per.groupBy(*keys, "column").agg(
        (F.count("value") / F.sum("_n") * 100).alias("unique_pct")
    )
    return agg.withColumn("is_stagnant", F.col("unique_pct") < limit)


def _messages(*pairs) -> Column:
    """Array of the texts whose condition holds."""
    texts = F.array(*[F.when(cond, text) for cond, text in pairs])
    return F.filter(texts, lambda t: t.isNotNull())


def _with_count(before: str, n: str, after: str = "") -> Column:
    return F.concat(F.lit(before), F.col(n).cast("string"), F.lit(after))


def consistency(df, *, keys=("symbol",), ts="ts", max_move=MAX_MOVE, ingest=None) -> DataFrame:
    """``is_valid`` with error texts: price logic, moves, volume, time; with an ``ingest`` column also
    whether rows came in the order of time."""
    base = df.groupBy(*keys).agg(*_ohlc_aggs(), *_volume_aggs())
    parts = [
        base,
        extreme_moves(df, keys=keys, ts=ts, limit=max_move),
        duplicate_times(df, keys=keys, ts=ts),
        large_gaps(df, keys=keys, ts=ts),
    ]
    if ingest:
        parts.append(chronological_order(df, keys=keys, ts=ts, ingest=ingest))
    out = _joined(parts, keys)
    disorder = (F.col("out_of_order") > 0) if ingest else F.lit(False)
    # The texts of the findings.
    errors = _messages(
        (disorder, F.lit("Timestamps are not in chronological order")),
        (
            F.col("high_violations") > 0,
            _with_count("Found ", "high_violations", " rows where high < max(open, close)"),
        ),
        (
            F.col("low_violations") > 0,
            _with_count("Found ", "low_violations", " rows where low > min(open, close)"),
        ),
        (
            F.col("high_low_violations") > 0,
            _with_count("Found ", "high_low_violations", " rows where high < low"),
        ),
        *[
            (
                F.col(f"non_positive_{c}") > 0,
                _with_count("Found ", f"non_positive_{c}", f" non-positive values in {c}"),
            )
            for c in PRICES
        ],
        (
            F.col("extreme_moves") > 0,
            _with_count("Found ", "extreme_moves", " extreme price changes"),
        ),
        (
            F.col("negative_volume") > 0,
            _with_count("Found ", "negative_volume", " negative volume values"),
        ),
        (
            F.col("zero_volume") > F.col("rows") * 0.1,
            _with_count("High proportion of zero volume: ", "zero_volume", " rows"),
        ),
        (
            F.col("duplicates") > 0,
            _with_count("Found ", "duplicates", " duplicate timestamps"),
        ),
        (
            F.col("large_gaps") > 0,
            _with_count("Found ", "large_gaps", " unusually large time gaps"),
        ),
    )
    return out.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def quality_warnings(df, *, keys=("symbol",), least_rows=1000, repeated=10.0, zero_volume=5.0) -> DataFrame:
    """Warning texts: few rows, one value repeated often in a price column, much zero volume."""
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), count_if(F.col("volume") == 0).alias("_zero")
    )
    often = repeated_share(df, keys=keys).groupBy(*keys).pivot("column", list(PRICES)).agg(
        F.first("repeated_pct")
    )
    often = often.select(*keys, *[F.col(c).alias(f"_rep_{c}") for c in PRICES])
    out = _joined([base, often], keys)
    zero = F.col("_zero") / F.col("_rows") * 100

    def percent(before: str, value: Column) -> Column:
        return F.concat(F.lit(before), F.format_string("%.1f", value), F.lit("%"))

    # The texts of the findings.
    texts = _messages(
        (F.col("_rows") < least_rows, _with_count("Limited data points: ", "_rows", " rows")),
        *[
            (
                F.col(f"_rep_{c}") > repeated,
                percent(f"High proportion of repeated values in {c}: ", F.col(f"_rep_{c}")),
            )
            for c in PRICES
        ],
        (zero > zero_volume, percent("High proportion of zero volume: ", zero)),
    )
    return out.select(*keys, texts.alias("warnings"))


def quality_report(
    df, *, keys=("symbol",), ts="ts", method="zscore", max_move=MAX_MOVE, ingest=None
) -> DataFrame:
    """Quality score: 100 less missing (max 30), errors (max 40) and outlier (max 20) points; error
    and warning texts."""
    cols = [c for c in df.columns if c not in keys]
    share = [count_if(F.col(c).isNull()) / F.count(F.lit(1)) * 100 for c in df.columns]
    missing = df.groupBy(*keys).agg(
        (sum(share[1:], share[0]) / len(cols + list(keys))).alias("avg_missing_pct")
    )
    odd = outlier_rows(df, method=method, keys=keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("outliers")
    )
    checks = consistency(df, keys=keys, ts=ts, max_move=max_move, ingest=ingest)
    out = _joined([checks, missing, odd, quality_warnings(df, keys=keys)], keys)
    out = out.withColumn("outliers", F.coalesce("outliers", F.lit(0)))
    n_err = F.size("errors")
    odd_pct = F.col("outliers") / F.col("rows") * 100
    score = (
        F.lit(100.0)
        - F.least(F.col("avg_missing_pct") * 2, F.lit(30.0))
        - F.least(n_err * 10.0, F.lit(40.0))
        - F.least(odd_pct, F.lit(20.0))
    )
    return out.select(
        *keys,
        "rows",
        "avg_missing_pct",
        n_err.cast("long").alias("n_errors"),
        "outliers",
        odd_pct.alias("outlier_pct"),
        F.greatest(score, F.lit(0.0)).alias("quality_score"),
        "is_valid",
        "errors",
        "warnings",
    )


def integrity_report(df, *, keys=("symbol",), ts="ts", ingest=None) -> DataFrame:
    """Three consistency verdicts with issue and warning texts."""
    base = df.groupBy(*keys).agg(*_ohlc_aggs())
    parts = [base, volume_checks(df, keys=keys), duplicate_times(df, keys=keys, ts=ts)]
    stale = uniqueness(df, keys=keys).groupBy(*keys).pivot("column", list(PRICES)).agg(
        F.first("unique_pct")
    )
    stale = stale.select(*keys, *[F.col(c).alias(f"unique_{c}") for c in PRICES])
    parts.append(stale)
    if ingest:
        parts.append(chronological_order(df, keys=keys, ts=ts, ingest=ingest))
    out = _joined(parts, keys)
    disorder = (F.col("out_of_order") > 0) if ingest else F.lit(False)
    # The texts of the findings.
    prices = _messages(
        (F.col("high_violations") > 0, _with_count("High price violations: ", "high_violations", " rows")),
        (F.col("low_violations") > 0, _with_count("Low price violations: ", "low_violations", " rows")),
        (
            F.col("high_low_violations") > 0,
            _with_count("High < Low violations: ", "high_low_violations", " rows"),
        ),
        *[
            (
                F.col(f"non_positive_{c}") > 0,
                _with_count(f"Non-positive {c} prices: ", f"non_positive_{c}", " rows"),
            )
            for c in PRICES
        ],
    )
    times = _messages(
        (disorder, F.lit("Timestamps not in chronological order")),
        (F.col("duplicates") > 0, _with_count("Duplicate timestamps: ", "duplicates")),
    )
    volumes = _messages(
        (F.col("negative_volume") > 0, _with_count("Negative volume values: ", "negative_volume", " rows")),
        (
            F.col("volume_q99") > F.col("volume_q50") * 100,
            _with_count("Potentially erroneous high volume: ", "erroneous_high", " rows"),
        ),
    )
    warnings = _messages(
        (F.col("rows") < 1000, _with_count("Limited data points: ", "rows", " rows")),
        (
            F.col("zero_share") > 0.1,
            F.format_string("High zero volume percentage: %.1f%%", F.col("zero_share") * 100),
        ),
        *[
            (
                F.col(f"unique_{c}") < 50,
                F.format_string(
                    f"Low price variation in {c}: %.1f%%%% unique values".replace("%%%%", "%%"),
                    F.col(f"unique_{c}"),
                ),
            )
            for c in PRICES
        ],
    )
    out = out.withColumns(
        {
            "ohlc_consistency": F.size(prices) == 0,
            "temporal_consistency": F.size(times) == 0,
            "volume_consistency": F.size(volumes) == 0,
            "issues": F.concat(prices, times, volumes),
            "warnings": warnings,
        }
    )
    return out.select(
        *keys,
        "ohlc_consistency",
        "temporal_consistency",
        "volume_consistency",
        "issues",
        "warnings",
        (F.size("issues") == 0).alias("is_valid"),
    )


def dataset_summary(df, *, keys=("symbol",), ts="ts") -> DataFrame:
    """Span, trading days, price mean and deviation, deviation of returns."""
    step = columns_step(lambda f: {"_ret": F.try_divide(F.col("close"), f.lag("close")) - 1}, back=1)
    s = over_series(df, step, keys=keys, order=ts)
    # Days are counted over (key, day) rows first: a distinct count without a wide state.
    days = s.groupBy(*keys, F.to_date(ts).alias("_d")).agg(F.lit(1).alias("_one"))
    days = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("trading_days"))
    agg = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
        F.avg("close").alias("price_mean"),
        F.stddev_samp("close").alias("price_std"),
        F.stddev_samp("_ret").alias("return_volatility"),
    )
    return null_safe_join(agg, days, list(keys))
