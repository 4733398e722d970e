"""Missing values, duplicates, gaps, outliers and repairs of bar tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.clock import micros, plus_micros
from barloom.plans.ordered import last_known, null_safe_join, with_position
from barloom.plans.quantiles import exact_quantiles, per_key
from barloom.plans.series import lay_out
from barloom.schema import OHLCV, PRICES
from barloom.session import durable

GRID_CHUNK = 4096


def keep_first(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    ts="ts",
    ingest: str | Sequence[str] | None = None,
) -> DataFrame:
    """One row per (key, time): the earliest ingested, that is the least by the ``ingest`` column or
    columns, which only a table without other columns can do without. Aggregates map-side, so a
    flood of copies of one bar never meets in one task."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    if not rest:
        return df.distinct()
    if not ingest:
        raise ValueError("name the column that tells which of the duplicates came first")
    by = [ingest] if isinstance(ingest, str) else list(ingest)
    row = F.struct(*by, *[c for c in rest if c not in by])
    return df.groupBy(*keys, ts).agg(F.min(row).alias("_first")).select(
        *[F.col(c) if c in (*keys, ts) else F.col(f"_first.{c}").alias(c) for c in df.columns]
    )


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=list(PRICES)).withColumn(
        "volume", F.coalesce("volume", F.lit(0).cast(df.schema["volume"].dataType))
    )


def clean_data(df, *, keys=("symbol",), ts="ts", ingest=None) -> DataFrame:
    """Complete prices, zero for missing volume, first of duplicate times."""
    return keep_first(drop_missing(df), keys=keys, ts=ts, ingest=ingest)


def _filled_volume(prev: str = "_pv") -> Column:
    return F.coalesce("volume", F.col(prev)["v"], F.lit(0.0))


def forward_fill(df, *, keys=("symbol",), ts="ts", width=None, ties=()) -> DataFrame:
    out = last_known(df, {f"_p{c}": c for c in OHLCV}, position=ts, keys=keys, order=ts, width=width, ties=ties)
    out = out.withColumns({c: F.col(f"_p{c}")["v"] for c in PRICES})
    out = out.withColumn("volume", F.coalesce(F.col("_pvolume")["v"], F.lit(0.0)))
    return out.select(*df.columns).na.drop(subset=list(PRICES))


def backward_fill(df, *, keys=("symbol",), ts="ts", width=None, ties=()) -> DataFrame:
    """Prices from the next known row; volume still fills forward, then with zero."""
    opts = {"position": ts, "keys": keys, "order": ts, "width": width, "ties": ties}
    out = last_known(df, {"_pv": "volume"}, {f"_n{c}": c for c in PRICES}, **opts)
    out = out.withColumns({c: F.col(f"_n{c}")["v"] for c in PRICES})
    out = out.withColumn("volume", _filled_volume())
    return out.select(*df.columns).na.drop(subset=list(PRICES))


def _lerp(at: Column, prev: Column, nxt: Column, offset: int = 0) -> Column:
    """Line from (prev.at + offset, prev.v) to nxt; holds prev.v where nothing follows."""
    start = prev["at"] + offset
    slope = F.try_divide(nxt["v"] - prev["v"], nxt["at"] - start)
    return F.coalesce(prev["v"] + slope * (at - start), prev["v"])


def interpolate(df, *, keys=("symbol",), ts="ts", width=None, ties=()) -> DataFrame:
    """Linear by row position, not by time; trailing holes hold the last value."""
    pos = with_position(df, keys=keys, order=ts, width=width, ties=ties)
    opts = {"position": "_rn", "keys": keys, "order": ts, "width": width, "ties": ties}
    out = last_known(pos, {f"_p{c}": c for c in OHLCV}, {f"_n{c}": c for c in PRICES}, **opts)
    out = out.withColumns(
        {c: F.coalesce(c, _lerp(F.col("_rn"), F.col(f"_p{c}"), F.col(f"_n{c}"))) for c in PRICES}
    )
    out = out.withColumn("volume", _filled_volume("_pvolume"))
    return out.select(*df.columns).na.drop(subset=list(PRICES))


FILLS = {
    "drop": lambda df, **k: drop_missing(df),
    "forward": forward_fill,
    "backward": backward_fill,
    "interpolate": interpolate,
}


def fill_missing(df, method: str = "forward", *, keys=("symbol",), ts="ts", ties=()) -> DataFrame:
    """``ties`` orders rows of equal time (the ingest column, where there is one)."""
    return FILLS[method](df, keys=keys, ts=ts, ties=ties)


def time_grid(df: DataFrame, every_us: int, *, keys=("symbol",), ts="ts") -> DataFrame:
    """Regular grid from each key's first to last time, with its step number ``g``.

    Steps are produced in chunks, spread over the cluster, so no row holds a whole series.
    """
    t = micros(df, ts)
    ends = df.groupBy(*keys).agg(
        F.min(ts).alias("_start"),
        F.min(t).alias("_t0"),
        F.max(t).alias("_t1"),
        F.count(F.lit(1)).alias("_rows"),
    )
    ends = ends.withColumn("_steps", F.floor((F.col("_t1") - F.col("_t0")) / every_us) + 1)
    last_chunk = F.floor((F.col("_steps") - 1) / GRID_CHUNK)
    chunks = ends.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)))
    chunks = chunks.repartition(*keys, "_c")
    lo = F.col("_c") * GRID_CHUNK
    hi = F.least(F.col("_steps") - 1, lo + GRID_CHUNK - 1)
    grid = chunks.withColumn("g", F.explode(F.sequence(lo, hi)))
    return grid.select(
        *keys,
        plus_micros(F.col("_start"), F.col("g") * every_us).alias(ts),
        "g",
        (F.col("_steps") > F.col("_rows")).alias("_fill"),
    )


def grid_join(df: DataFrame, every_us: int, *, keys=("symbol",), ts="ts") -> DataFrame:
    """Bars on the regular grid; missing steps carry nulls."""
    return null_safe_join(time_grid(df, every_us, keys=keys, ts=ts), df, [*keys, ts])


def fill_time_gaps(
    df: DataFrame,
    every_us: int,
    limit: int,
    *,
    keys=("symbol",),
    ts="ts",
    width=None,
    session: tuple[int, int] | None = None,
) -> DataFrame:
    """Put bars on a regular grid and close gaps.

    The first ``limit`` missing steps repeat the last bar, the next ``limit`` run on a line to
    the bar after the gap, later steps are dropped. Rows off the grid are lost. A key whose grid
    is not longer than its rows is only put on the grid. ``session`` keeps synthetic steps within
    these minutes of the day.
    """
    cols = [c for c in df.columns if c not in (*keys, ts)]
    full = grid_join(df, every_us, keys=keys, ts=ts)
    if session:
        minute = F.hour(ts) * 60 + F.minute(ts)
        full = full.filter(F.col("close").isNotNull() | minute.between(*session))
    opts = {"position": "g", "keys": keys, "order": ts, "width": width}
    out = last_known(full, {f"_p{c}": c for c in cols}, {f"_n{c}": c for c in cols}, **opts)
    filled = {}
    for c in cols:
        prev, nxt, gap = F.col(f"_p{c}"), F.col(f"_n{c}"), F.col("g") - F.col(f"_p{c}")["at"]
        line = _lerp(F.col("g"), prev, nxt, limit)
        new = F.when(gap <= limit, prev["v"]).when(gap <= 2 * limit, line)
        filled[c] = F.when(F.col("_fill") & F.col(c).isNull(), new).otherwise(F.col(c))
    out = out.withColumns(filled)
    complete = ~F.col("_fill")
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    return out.filter(complete | whole).select(*df.columns)


# ------------------------------------------------------------------------------ outliers


def mark_iqr(df, cols: Sequence[str] = OHLCV, *, keys=("symbol",), k=1.5) -> DataFrame:
    """Add ``out_<col>``: outside the quartile fences of the key."""
    q = exact_quantiles(df, {c: (0.25, 0.75) for c in cols}, keys=keys)
    out = per_key(df, q, keys)
    marks = {}
    for c in cols:
        q1, q3 = F.col(f"q_{c}_0"), F.col(f"q_{c}_1")
        beyond = (F.col(c) < q1 - k * (q3 - q1)) | (F.col(c) > q3 + k * (q3 - q1))
        marks[f"out_{c}"] = F.coalesce(beyond, F.lit(False))
    return out.withColumns(marks).select(*df.columns, *marks)


def mark_zscore(df, cols: Sequence[str] = OHLCV, *, keys=("symbol",), threshold=3.0) -> DataFrame:
    """Add ``out_<col>``: more than ``threshold`` population deviations from the key's mean."""
    stats = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols],
    )
    out = per_key(df, stats, keys)
    marks = {
        f"out_{c}": F.coalesce(
            F.abs(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))) > threshold,
            F.lit(False),
        )
        for c in cols
    }
    return out.withColumns(marks).select(*df.columns, *marks)


def _marked(df, cols, method, keys, threshold=3.0):
    if method == "iqr":
        return mark_iqr(df, cols, keys=keys)
    return mark_zscore(df, cols, keys=keys, threshold=threshold)


def outlier_rows(df, cols=OHLCV, *, method="zscore", keys=("symbol",), threshold=3.0) -> DataFrame:
    """Rows flagged in any column."""
    m = _marked(df, cols, method, keys, threshold)
    flag = F.lit(False)
    for c in cols:
        flag = flag | F.col(f"out_{c}")
    return m.filter(flag).select(*df.columns)


def clamp_price_outliers(df, *, method="iqr", keys=("symbol",), threshold=3.0) -> DataFrame:
    """Flagged prices are clipped to median +- 5 median absolute deviations."""
    m = _marked(df, PRICES, method, keys, threshold)
    med = exact_quantiles(df, {c: (0.5,) for c in PRICES}, keys=keys)
    m = durable(per_key(m, med, keys))
    m = m.withColumns({f"dev_{c}": F.abs(F.col(c) - F.col(f"q_{c}_0")) for c in PRICES})
    dev = exact_quantiles(m, {f"dev_{c}": (0.5,) for c in PRICES}, keys=keys)
    m = per_key(m, dev, keys)
    new = {}
    for c in PRICES:
        mid, mad = F.col(f"q_{c}_0"), F.col(f"q_dev_{c}_0")
        clipped = F.least(F.greatest(F.col(c), mid - 5 * mad), mid + 5 * mad)
        new[c] = F.when(F.col(f"out_{c}"), clipped).otherwise(F.col(c))
    return m.withColumns(new).select(*df.columns)


def cap_volume_outliers(df, *, method="iqr", keys=("symbol",), threshold=3.0) -> DataFrame:
    """Flagged volumes are capped at the key's 99th percentile."""
    m = _marked(df, ("volume",), method, keys, threshold)
    m = per_key(m, exact_quantiles(df, {"volume": (0.99,)}, keys=keys), keys)
    capped = F.least(F.col("volume"), F.col("q_volume_0"))
    return m.withColumn(
        "volume", F.when(F.col("out_volume"), capped).otherwise(F.col("volume"))
    ).select(*df.columns)


# ------------------------------------------------------------------------------- repairs


def repair_ohlc(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "high": F.greatest("high", "open", "close"),
            "low": F.least("low", "open", "close"),
        }
    )


def repair_volume(df: DataFrame) -> DataFrame:
    return df.withColumn("volume", F.abs("volume"))


def _clamped(close: Column, before: Column, cap: float) -> Column:
    return F.least(F.greatest(close, before - before * cap), before + before * cap)


def _fold_run(run: Column, start: Column, cap: float) -> Column:
    """Repaired closes of a run of flagged rows (``_rn``, ``close`` in order) after the close ``start``."""
    y = "y"
    told = F.aggregate(
        run,
        F.struct(start.alias(y), F.array().cast("array<struct<_rn:bigint,y:double>>").alias("out")),
        lambda acc, r: F.transform(
            F.array(_clamped(r["close"], acc[y], cap)),
            lambda v: F.struct(v.alias(y), F.concat(acc["out"], F.array(F.struct(r["_rn"].alias("_rn"), v.alias(y)))).alias("out")),
        )[0],
    )
    return told["out"]


def _ends_of(first: Column, second: Column, slope: Column, of: str, to: str, at: Column) -> Column:
    """Value of a piecewise linear curve through the origin: ``first`` are its knots below ``at``,
    ``second`` the others; beyond the last knot it goes on with ``slope``."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    p = F.coalesce(F.try_element_at(first, F.lit(-1)), zero)
    q = F.try_element_at(second, F.lit(1))
    step = slope if of == "x" else 1.0 / slope
    between = (at - p[of]) * (q[to] - p[to]) / (q[of] - p[of])
    return p[to] + F.when(q.isNull(), (at - p[of]) * step).otherwise(between)


def _run_map(run: Column, cap: float) -> Column:
    """What a run of flagged rows makes of a positive close before it. Each row is the monotone map
    ``x -> min(max(close, x (1 - cap)), x (1 + cap))``; composed, they stay monotone and piecewise linear.
    Knots that a row puts on its own close are dropped."""
    low, high = 1.0 - cap, 1.0 + cap

    def knot(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    def reached(m: Column, level: Column) -> Column:
        """Least x at which the map has this value."""
        below = F.filter(m["knots"], lambda k: k["y"] < level)
        above = F.filter(m["knots"], lambda k: k["y"] >= level)
        return _ends_of(below, above, m["slope"], "y", "x", level)

    def left(m: Column, level: Column) -> Column:
        """Greatest x at which the map has this value: knots may lie on it."""
        below = F.filter(m["knots"], lambda k: k["y"] <= level)
        above = F.filter(m["knots"], lambda k: k["y"] > level)
        return _ends_of(below, above, m["slope"], "y", "x", level)

    def after(m: Column, r: Column) -> Column:
        c = r["close"]
        rising = F.transform(F.filter(m["knots"], lambda k: k["y"] < c / high), lambda k: knot(k["x"], k["y"] * high))
        falling = F.transform(F.filter(m["knots"], lambda k: k["y"] > c / low), lambda k: knot(k["x"], k["y"] * low))
        level = F.array(knot(reached(m, c / high), c), knot(left(m, c / low), c))
        knots = F.when(c > 0, F.concat(rising, level, falling)).otherwise(falling)
        return F.struct(knots.alias("knots"), (m["slope"] * low).alias("slope"), (m["n"] + 1).alias("n"))

    none = F.array().cast("array<struct<x:double,y:double>>")
    return F.aggregate(run, F.struct(none.alias("knots"), F.lit(1.0).alias("slope"), F.lit(0).alias("n")), after)


def _through(m: Column, x: Column, cap: float) -> Column:
    """Value of a map of ``_run_map``; below zero every row multiplies by ``1 + cap``."""
    inside = _ends_of(
        F.filter(m["knots"], lambda k: k["x"] <= x), F.filter(m["knots"], lambda k: k["x"] > x), m["slope"], "x", "y", x
    )
    return F.when(x > 0, inside).otherwise(x * F.pow(F.lit(1.0 + cap), m["n"]))


def cap_close_moves(df, cap: float = 0.2, *, keys=("symbol",), ts="ts", block_rows=None) -> DataFrame:
    """Clamp closes that moved more than ``cap`` (below 1) to the band around the repaired previous close.

    A clamp leans on the one before it, so runs of flagged rows chain. Runs are folded inside blocks.
    A block that is flagged throughout is a monotone, piecewise linear map of the close before it; such
    maps are applied along their chain, one row per block, and every other block knows its last close
    by itself. The result is the sequential one, however many blocks a run crosses.
    """
    if not 0 < cap < 1:
        raise ValueError("cap lies between 0 and 1")
    keys = list(keys)
    laid, frame = lay_out(df, back=1, ahead=0, keys=keys, order=ts, block_rows=block_rows)
    move = F.abs(F.try_divide(F.col("close"), frame.lag("close")) - 1) > cap
    laid = laid.withColumn("_hit", F.coalesce(move, F.lit(False))).filter("_own")
    rows = durable(laid.select(*df.columns, "_blk", "_rn", "_hit"))
    block = [*keys, "_blk"]
    so_far = Window.partitionBy(*block).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    calm = F.when(~F.col("_hit"), F.struct("_rn", "close"))
    slim = rows.select(*block, "_rn", F.col("close").cast("double").alias("close"), "_hit")
    marked = slim.withColumn("_anchor", F.max(calm).over(so_far))
    runs = durable(
        marked.filter("_hit")
        .groupBy(*block, "_anchor")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "close"))).alias("_run"))
    )
    inner = runs.filter("_anchor IS NOT NULL").select(
        *block, _fold_run(F.col("_run"), F.col("_anchor.close"), cap).alias("_out")
    )
    heads = runs.filter("_anchor IS NULL").select(*block, "_run")

    # The last close of each block, where the block knows it, or else its map.
    ends = slim.groupBy(*block).agg(
        F.max(F.struct("_rn", "_hit", "close")).alias("_last"), F.bool_and("_hit").alias("_whole")
    )
    tails = inner.select(*block, F.element_at("_out", -1).alias("_t"))
    tails = tails.groupBy(*block).agg(F.max("_t").alias("_t"))
    maps = null_safe_join(heads, ends.filter("_whole").select(*block), block, "left_semi")
    maps = maps.select(*block, _run_map(F.col("_run"), cap).alias("_map"))
    known = null_safe_join(null_safe_join(ends, tails, block), maps, block)
    known = known.withColumn(
        "_end",
        F.when(F.col("_whole"), F.lit(None)).when(F.col("_last._hit"), F.col("_t.y")).otherwise(F.col("_last.close")),
    )
    by_block = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    told = F.when(~F.col("_whole"), F.struct(F.col("_blk").alias("b"), F.col("_end").alias("y")))
    known = known.withColumn("_from", F.max(told).over(by_block))
    chains = known.filter(F.col("_whole") & F.col("_from").isNotNull()).groupBy(*keys, "_from").agg(
        F.array_sort(F.collect_list(F.struct("_blk", "_map"))).alias("_maps")
    )
    passed = F.aggregate(
        "_maps",
        F.struct(
            F.col("_from.y").alias("y"), F.array().cast("array<struct<_blk:bigint,y:double>>").alias("out")
        ),
        lambda acc, m: F.transform(
            F.array(_through(m["_map"], acc["y"], cap)),
            lambda v: F.struct(
                v.alias("y"),
                F.concat(acc["out"], F.array(F.struct(m["_blk"].alias("_blk"), v.alias("y")))).alias("out"),
            ),
        )[0],
    )
    passed = chains.select(*keys, F.explode(passed["out"]).alias("_o")).select(*keys, "_o._blk", F.col("_o.y").alias("_in"))
    handed = known.filter(~F.col("_whole")).select(*block, F.col("_end").alias("_in")).unionByName(passed)
    handed = handed.withColumn("_blk", F.col("_blk") + 1)
    started = null_safe_join(heads, handed, block).select(
        *block, _fold_run(F.col("_run"), F.col("_in"), cap).alias("_out")
    )
    repaired = inner.unionByName(started).select(*block, F.explode("_out").alias("_o"))
    repaired = repaired.select(*block, "_o._rn", F.col("_o.y").alias("_y"))
    out = null_safe_join(rows, repaired, [*block, "_rn"])
    kind = df.schema["close"].dataType
    return out.withColumn("close", F.coalesce(F.col("_y").cast(kind), F.col("close"))).select(*df.columns)


def preprocess(
    df: DataFrame,
    every_us: int,
    limit: int,
    *,
    fill="forward",
    method="zscore",
    cap=0.2,
    keys=("symbol",),
    ts="ts",
    ingest=None,
) -> DataFrame:
    """Fill, deduplicate, close gaps, tame outliers, repair: the whole cleaning chain. Without an
    ``ingest`` column the least of duplicate bars by its values stays.

    Each stage reads its input more than once, so stages hand over through the shared folder
    instead of multiplying the plan.
    """
    out = fill_missing(df, fill, keys=keys, ts=ts, ties=[ingest] if ingest else ())
    out = keep_first(out, keys=keys, ts=ts, ingest=ingest or list(OHLCV))
    if ingest:
        out = out.drop(ingest)
    out = durable(fill_time_gaps(durable(out), every_us, limit, keys=keys, ts=ts))
    out = clamp_price_outliers(out, method=method, keys=keys)
    out = durable(cap_volume_outliers(durable(out), method=method, keys=keys))
    out = repair_volume(repair_ohlc(out))
    return cap_close_moves(out, cap, keys=keys, ts=ts)
