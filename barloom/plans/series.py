"""Blocks with halos: bounded window frames over series of any length.

Rows get their exact position within the key, are cut into blocks of ``block_rows`` positions,
and the rows a neighbour block needs (``back`` before, ``ahead`` after) are copied into it. All
windows then run per ``(key, block)``: one shuffle, one sort, no task larger than a block, however
many rows one symbol holds. Copies are dropped at the end.

A feature is a ``Step``: a function ``(df, frame) -> df`` with the history it needs. Steps handed
to one ``over_series`` call share the layout.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.plans.ordered import null_safe_join, with_position
from barloom.session import durable

SUB_ROWS = 1024
MIN_BLOCK = 8192
# Block plus halo stays below this where it can, so that every decay fits one of the two forms.
SPAN = 15_000
# A weight below exp(-39) = 1e-17 no longer changes a double.
TAIL = 39.0
# From this length on, the extreme of a frame is joined from two running ones.
LONG_FRAME = 128
# Largest exponent used in a scaled running sum; exp(600) is far from overflow.
SAFE_EXP = 600.0


_SQL_NAME = {
    F.avg: "avg",
    F.sum: "sum",
    F.min: "min",
    F.max: "max",
    F.stddev_samp: "stddev_samp",
}


def _bound(n: int | None) -> str:
    if n is None:
        return "UNBOUNDED PRECEDING"
    return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"


@dataclass(frozen=True)
class Frame:
    """Window specs of one layout."""

    keys: tuple[str, ...]
    order: str
    block_rows: int
    back: int
    ahead: int
    #: Columns that rolling extremes of long frames need beside the rows (see ``with_columns``).
    aside: dict[str, Column] = field(default_factory=dict, compare=False, repr=False)

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_blk").orderBy("_sub", "_rn")

    @property
    def w_sub(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_blk", "_sub").orderBy("_rn")

    def rows(self, a: int, b: int) -> WindowSpec:
        return self.w.rowsBetween(a, b)

    @property
    def so_far(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def rn(self) -> Column:
        return F.col("_rn")

    @property
    def base(self) -> Column:
        """Position of the first row a block can hold, minus one."""
        return F.greatest(F.lit(0), F.col("_blk") * self.block_rows - self.back)

    @property
    def span(self) -> int:
        return self.block_rows + self.back + self.ahead

    # Windows over named columns are written as SQL text: one call into the JVM instead of dozens,
    # which is what building wide feature tables would otherwise spend its time on.

    @property
    def over(self) -> str:
        keys = ", ".join(f"`{k}`" for k in (*self.keys, "_blk"))
        return f"PARTITION BY {keys} ORDER BY `_sub`, `_rn`"

    def over_rows(self, a: int | None, b: int) -> str:
        return f"OVER ({self.over} ROWS BETWEEN {_bound(a)} AND {_bound(b)})"

    def lag(self, c, n: int = 1) -> Column:
        if isinstance(c, str):
            return F.expr(f"lag(`{c}`, {n}) OVER ({self.over})")
        return F.lag(c, n).over(self.w)

    def lead(self, c, n: int = 1) -> Column:
        if isinstance(c, str):
            return F.expr(f"lead(`{c}`, {n}) OVER ({self.over})")
        return F.lead(c, n).over(self.w)

    def _last_gap(self, c: str) -> str:
        """Position of the last null up to this row, or of the row before the block's first. One
        growing frame per column instead of a sliding count per length."""
        gap = f"max(CASE WHEN `{c}` IS NULL THEN `_rn` END) {self.over_rows(None, 0)}"
        return f"coalesce({gap}, greatest(0, `_blk` * {self.block_rows} - {self.back}))"

    def roll(self, agg: Callable, c, n: int) -> Column:
        """Aggregate over the last n rows, null until all n are non-null."""
        if isinstance(c, str) and agg in (F.min, F.max) and n >= LONG_FRAME:
            return F.expr(f"CASE WHEN `_rn` - {self._last_gap(c)} >= {n} THEN {self._extreme(agg, c, n)} END")
        if isinstance(c, str) and agg in _SQL_NAME:
            value = f"{_SQL_NAME[agg]}(`{c}`) {self.over_rows(-(n - 1), 0)}"
            return F.expr(f"CASE WHEN `_rn` - {self._last_gap(c)} >= {n} THEN {value} END")
        c = F.col(c) if isinstance(c, str) else c
        f = self.rows(-(n - 1), 0)
        return F.when(F.count(c).over(f) == n, agg(c).over(f))

    def _extreme(self, agg: Callable, c: str, n: int) -> str:
        """Extreme of the last n rows at a cost that does not grow with n. Rows are cut every n: a frame
        is the end of one piece and the beginning of the next, so the extreme so far of its last row
        and the extreme from its first row on cover it. A sliding frame visits n rows for each."""
        name, join = ("max", "greatest") if agg is F.max else ("min", "least")
        tag = f"_{name}_{c}_{n}"
        keys = ", ".join(f"`{k}`" for k in (*self.keys, "_blk"))
        piece = f"OVER (PARTITION BY {keys}, floor((`_rn` - 1) / {n}) ORDER BY `_rn`"
        to_row = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        self.aside[f"{tag}_so_far"] = F.expr(f"{name}(`{c}`) {piece} {to_row}")
        self.aside[f"{tag}_to_end"] = F.expr(f"{name}(`{c}`) {piece} DESC {to_row}")
        return f"{join}(lag(`{tag}_to_end`, {n - 1}) OVER ({self.over}), `{tag}_so_far`)"

    def with_columns(self, df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
        """Add columns, with what their long frames need; ``roll`` of a long extreme goes through here."""
        if not self.aside:
            return df.withColumns(dict(cols))
        helpers = dict(self.aside)
        self.aside.clear()
        return df.withColumns(helpers).withColumns(dict(cols)).drop(*helpers)

    def roll_any(self, agg: Callable, c, n: int) -> Column:
        """Aggregate over up to the last n rows."""
        return agg(c).over(self.rows(-(n - 1), 0))

    def next_agg(self, agg: Callable, c, n: int, start: int = 1, full: bool = False) -> Column:
        """Aggregate over rows start..n ahead; with ``full`` null unless all are there."""
        c = F.col(c) if isinstance(c, str) else c
        f = self.rows(start, n)
        if not full:
            return agg(c).over(f)
        return F.when(F.count(c).over(f) == n - start + 1, agg(c).over(f))


@dataclass(frozen=True)
class Phase:
    """Part of a recursive step: columns of a bounded frame (``build``) or exponential averages (``outs``)."""

    build: Callable[[DataFrame, Frame], DataFrame] | None = None
    outs: Mapping[str, Smooth] | None = None
    back: int = 0
    ahead: int = 0


@dataclass(frozen=True)
class Step:
    """One group of columns computed inside a layout. A step with exponential averages names its
    ``phases`` and the columns it ``reads``, whose nulls decide how it is computed."""

    build: Callable[[DataFrame, Frame], DataFrame]
    back: int = 0
    ahead: int = 0
    name: str = field(default="step")
    reads: tuple[str, ...] = ()
    phases: tuple[Phase, ...] = ()


def columns_step(make: Callable[[Frame], Mapping[str, Column]], back=0, ahead=0, name="step"):
    """Step that adds the columns ``make(frame)`` returns."""
    return Step(lambda df, fr: fr.with_columns(df, make(fr)), back, ahead, name)


def recursive_step(phases: Sequence[Phase], reads: Sequence[str], name: str) -> Step:
    """Step of alternating frame columns and exponential averages."""

    def build(df, fr):
        for p in phases:
            df = smooth(df, fr, p.outs) if p.outs else p.build(df, fr)
        return df

    back = sum(max((s.back for s in p.outs.values()), default=0) if p.outs else p.back for p in phases)
    return Step(build, back, max((p.ahead for p in phases), default=0), name, tuple(reads), tuple(phases))


def chain(*steps: Step, name="chain") -> Step:
    """Steps where each reads the columns of the ones before: their histories add up."""

    def build(df, fr):
        for s in steps:
            df = s.build(df, fr)
        return df

    phases: tuple[Phase, ...] = ()
    if any(s.phases for s in steps):
        phases = tuple(q for s in steps for q in (s.phases or (Phase(s.build, None, s.back, s.ahead),)))
    reads = tuple(dict.fromkeys(c for s in steps for c in s.reads))
    return Step(build, sum(s.back for s in steps), sum(s.ahead for s in steps), name, reads, phases)


def lay_out(
    df: DataFrame,
    *,
    back: int,
    ahead: int,
    keys: Sequence[str] = ("symbol",),
    order: str = "ts",
    ties: Sequence[str] = (),
    width: int | str | None = None,
    block_rows: int | None = None,
) -> tuple[DataFrame, Frame]:
    """Cut into blocks with halo copies. Rows where ``_own`` is false are copies."""
    halo = back + ahead
    size = block_rows or max(halo, min(max(MIN_BLOCK, 4 * halo), SPAN - halo))
    if "_rn" not in df.columns:
        df = with_position(df, keys=keys, order=order, ties=ties, width=width)
    at = F.col("_rn") - 1
    home = F.floor(at / size)
    if back or ahead:
        first = F.greatest(F.lit(0).cast("long"), F.floor((at - ahead) / size))
        final = F.floor((at + back) / size)
        df = df.withColumn("_blk", F.explode(F.sequence(first, final)))
    else:
        df = df.withColumn("_blk", home)
    df = df.withColumns({"_own": F.col("_blk") == home, "_sub": F.floor(at / SUB_ROWS)})
    return df, Frame(tuple(keys), order, size, back, ahead)


def over_series(
    df: DataFrame,
    *steps: Step,
    keys: Sequence[str] = ("symbol",),
    order: str = "ts",
    ties: Sequence[str] = (),
    width: int | str | None = None,
    block_rows: int | None = None,
    position: str | None = None,
    gaps: bool | None = None,
) -> DataFrame:
    """Apply steps inside one layout; ``position`` keeps the row number under that name.

    Steps may read columns of earlier steps as long as their own ``back`` covers the whole
    chain of rows behind them (``chain`` adds histories up).

    Exponential averages share the layout where the columns they read hold no nulls; a count tells
    (none is made where the schema rules nulls out). Over nulls a bounded history cannot tell how an
    average stands, so there they run on states handed from block to block (``smooth_gappy``), and the
    steps go one after another. ``gaps`` states whether there are nulls, in place of the count.
    """
    had_rn = "_rn" in df.columns
    recursive = [s for s in steps if s.phases]
    if recursive and (_has_gaps(df, recursive) if gaps is None else gaps):
        if not had_rn:
            df = with_position(df, keys=keys, order=order, ties=ties, width=width)
        for i, (together, group) in enumerate(_grouped(df, steps)):
            if not together:
                df = _in_frames(df, group, keys, order, block_rows)
                continue
            # A round reads its input twice, for states and rows: later groups start from a written table.
            df = durable(df) if i > 1 else df
            for frames, outs in _rounds(group):
                df = _in_frames(df, frames, keys, order, block_rows)
                if outs:
                    df = smooth_gappy(df, outs, keys=keys, order=order, block_rows=block_rows)
        laid = df
    else:
        laid = _in_frames(df, steps, keys, order, block_rows, ties, width)
    if position:
        laid = laid.withColumn(position, F.col("_rn"))
    return laid if had_rn else laid.drop("_rn")


def _in_frames(df, steps, keys, order, block_rows, ties=(), width=None) -> DataFrame:
    """Steps in one layout; the row number stays."""
    if not steps and "_rn" in df.columns:
        return df
    laid, frame = lay_out(
        df,
        back=max([s.back for s in steps], default=0),
        ahead=max([s.ahead for s in steps], default=0),
        keys=keys,
        order=order,
        ties=ties,
        width=width,
        block_rows=block_rows,
    )
    for s in steps:
        laid = s.build(laid, frame)
    return laid.filter("_own").drop("_blk", "_own", "_sub")


def _grouped(df: DataFrame, steps: Sequence[Step]) -> list[tuple[bool, list[Step]]]:
    """Steps in order, as runs of recursive ones that do not read each other's columns, and the rest."""
    out: list[tuple[bool, list[Step]]] = []
    have = set(df.columns)
    for s in steps:
        together = bool(s.phases)
        if not out or out[-1][0] != together or (together and not set(s.reads) <= have):
            out.append((together, []))
        out[-1][1].append(s)
    return out


def _rounds(steps: Sequence[Step]) -> list[tuple[list[Step], dict[str, Smooth]]]:
    """Phases of several recursive steps side by side: frame columns, then averages, and again."""
    rounds: list[tuple[list[Step], dict[str, Smooth]]] = []
    for s in steps:
        at, closed = 0, False
        for p in s.phases:
            at, closed = (at + 1, False) if closed else (at, closed)
            while len(rounds) <= at:
                rounds.append(([], {}))
            if p.outs:
                rounds[at][1].update(p.outs)
                closed = True
            else:
                rounds[at][0].append(Step(p.build, p.back, p.ahead))
    return rounds


def _has_gaps(df: DataFrame, steps: Sequence[Step]) -> bool:
    """Does a column that recursive steps read hold nulls? Columns of earlier steps may."""
    reads = {c for s in steps for c in s.reads}
    if not reads <= set(df.columns):
        return True
    open_to = sorted(c for c in reads if df.schema[c].nullable)
    if not open_to:
        return False
    known = [F.count(c) for c in open_to]
    n, *found = df.agg(F.count(F.lit(1)), *known).first()
    return any(k < n for k in found)


# ---------------------------------------------------------------- exponential smoothing


def decay_rate(alpha: float) -> float:
    return -math.log(1.0 - alpha)


def ema_history(alpha: float) -> int:
    """Rows after which an earlier value no longer changes the result."""
    return 0 if alpha >= 1 else math.ceil(TAIL / decay_rate(alpha))


def span_alpha(n: int) -> float:
    return 2.0 / (n + 1.0)


def wilder_alpha(n: int) -> float:
    return 1.0 / n


@dataclass(frozen=True)
class Smooth:
    """One exponential average: source column, weight, leading nulls, seeding by a mean, and rows at a
    halo's start whose source looks back beyond it (``skip``)."""

    source: str
    alpha: float
    lead: int = 0
    adjusted: bool = False
    sma_seed: int = 0
    skip: int = 0

    @property
    def back(self) -> int:
        return ema_history(self.alpha) + self.sma_seed

    @property
    def rate(self) -> float:
        return decay_rate(self.alpha) if self.alpha < 1 else 1e4  # a weight of 1 forgets at once

    def kept(self, rows: Column) -> Column:
        """What a weight falls to in so many rows."""
        return F.pow(F.lit(1.0 - self.alpha), rows)


def _decayed_sum(fr: Frame, name: str, term: str, s: Smooth) -> tuple[dict, dict, str]:
    """Columns, later columns and expression of ``sum(term * d^(rows since))`` up to each row.

    The sum unrolls to ``d^e * sum(term * d^-e)``. Slow decays fit one running sum over the block. Fast
    ones would overflow, so they run per sub-block of ``SUB_ROWS`` and add the end of the sub-block
    before it; anything older weighs < exp(-70). The fastest forget within some dozen rows, which are
    added up one by one.
    """
    base = f"greatest(0, `_blk` * {fr.block_rows} - {fr.back})"
    rate, alpha = s.rate, s.alpha
    direct = rate * fr.span <= SAFE_EXP
    if not direct and rate * SUB_ROWS > 690:
        parts = [
            f"coalesce(lag({term}, {i}) OVER ({fr.over}), 0D) * {(1.0 - alpha) ** i!r}D"
            for i in range(math.ceil(TAIL / rate), 0, -1)
        ]
        return {name: F.expr(" + ".join([*parts, f"coalesce({term}, 0D)"]))}, {}, f"`{name}`"
    keys = ", ".join(f"`{k}`" for k in (*fr.keys, "_blk", "_sub"))
    in_sub = f"OVER (PARTITION BY {keys} ORDER BY `_rn` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    e = f"(`_rn` - {base})" if direct else f"((`_rn` - 1) % {SUB_ROWS})"
    over = fr.over_rows(None, 0) if direct else in_sub
    level = {name: F.expr(f"exp({e} * -{rate!r}D) * sum(({term}) * exp({e} * {rate!r}D)) {over}")}
    if direct:
        return level, {}, f"coalesce(`{name}`, 0D)"
    if rate * SUB_ROWS < 36:
        raise ValueError("pass a smaller block_rows for this mix of smoothing lengths")
    end = f"CASE WHEN `_rn` % {SUB_ROWS} = 0 THEN coalesce(`{name}`, 0D) END"
    late = {f"{name}_c": F.expr(f"last_value({end}, true) {fr.over_rows(None, -1)}")}
    carried = f"coalesce(exp(({e} + 1) * -{rate!r}D) * `{name}_c`, 0D)"
    return level, late, f"(coalesce(`{name}`, 0D) + {carried})"


def smooth(df: DataFrame, fr: Frame, outs: Mapping[str, Smooth]) -> DataFrame:
    """Exponential averages ``y[t] = d*y[t-1] + a*x[t]`` of sources without nulls after ``lead`` rows.

    One decayed sum per average; what the weights add up to is known from the row number alone. A
    block starts at its halo, whose first row stands for all history (weight below 1e-17).
    """
    so_far = fr.over_rows(None, 0)
    base = f"greatest(0, `_blk` * {fr.block_rows} - {fr.back})"
    seeds = {
        f"_x_{o}": fr.roll(F.avg, s.source, s.sma_seed) for o, s in outs.items() if s.sma_seed and s.alpha < 1
    }
    df = df.withColumns(seeds) if seeds else df
    level, late, final, temporary = {}, {}, {}, [*seeds]
    begun: dict[str, str] = {}
    for out, s in outs.items():
        first = f"(greatest({base} + {s.skip}, {s.lead}L) + {max(s.sma_seed, 1)})"
        if s.alpha >= 1:
            final[out] = F.expr(f"CASE WHEN `_rn` > {s.lead} THEN `{s.source}` END")
            continue
        start = f"`_x_{out}`" if s.sma_seed else f"`{s.source}`"
        x = f"CASE WHEN `_rn` = {first} THEN {start} WHEN `_rn` > {first} THEN `{s.source}` END"
        if not (s.lead or s.skip or s.sma_seed):
            x = f"`{s.source}`"
        columns, later, total = _decayed_sum(fr, f"_n_{out}", x, s)
        level.update(columns)
        late.update(later)
        temporary += [*columns, *later]
        ahead = f"exp((`_rn` - {first} + 1) * -{s.rate!r}D)"
        if s.adjusted:
            y = f"{total} * {s.alpha!r}D / (1D - {ahead})"
        else:
            if x not in begun:
                begun[x] = f"_v_{len(begun)}"
                level[begun[x]] = F.expr(f"first_value({x}, true) {so_far}")
                temporary.append(begun[x])
            v = f"`{begun[x]}`"
            y = f"CASE WHEN `_rn` = {first} THEN {v} ELSE {s.alpha!r}D * {total} + {ahead} * {v} END"
        final[out] = F.expr(f"CASE WHEN `_rn` >= {first} THEN {y} END")
    for stage in (level, late):
        df = df.withColumns(stage) if stage else df
    return df.withColumns(final).drop(*temporary)


def smooth_gappy(
    df: DataFrame,
    outs: Mapping[str, Smooth],
    *,
    keys: Sequence[str] = ("symbol",),
    order: str = "ts",
    block_rows: int | None = None,
) -> DataFrame:
    """Exponential averages over sources with nulls, for rows that have their position (``_rn``).

    The average of a row is the weighted mean of the known values up to it. A value's weight falls
    by ``d = 1 - alpha`` per row, rows without a value included; the first known value weighs 1, later
    ones ``alpha`` (``adjusted``: all weigh 1). A null keeps the last average, however long the run, and
    nothing is known before the first known value.

    A block of rows reduces to the state at its last known row: position, weighted sum and weight.
    Two states in a row make one (the earlier one decays by the rows between); a block starts from the
    state of all before it. States are one row per block, and only so many of the last ones count as
    a decay of 1e-17 takes.
    """
    keys = list(keys)
    size = block_rows or MIN_BLOCK
    seeded = {o: s for o, s in outs.items() if s.sma_seed and s.alpha < 1}
    if seeded:
        means = columns_step(
            lambda f: {f"_x_{o}": f.roll(F.avg, s.source, s.sma_seed) for o, s in seeded.items()},
            back=max(s.sma_seed for s in seeded.values()),
        )
        df = _in_frames(df, [means], keys, order, block_rows)
        at = [
            F.min(F.when(F.col(f"_x_{o}").isNotNull() & (F.col("_rn") > s.lead), F.col("_rn"))).alias(f"_f_{o}")
            for o, s in seeded.items()
        ]
        df = null_safe_join(df, df.groupBy(*keys).agg(*at), keys)
    rows, fr = lay_out(df, back=0, ahead=0, keys=keys, order=order, block_rows=size)
    level, late, sums, known = {}, {}, {}, {}
    for o, s in outs.items():
        x = f"`{s.source}`"
        if o in seeded:
            x = f"CASE WHEN `_rn` = `_f_{o}` THEN `_x_{o}` WHEN `_rn` > `_f_{o}` THEN {x} END"
        elif s.lead:
            x = f"CASE WHEN `_rn` > {s.lead} THEN {x} END"
        known[o] = F.expr(x).cast("double")
        for part, term in (("n", x), ("d", f"CASE WHEN {x} IS NOT NULL THEN 1D END")):
            columns, later, total = _decayed_sum(fr, f"_{part}_{o}", term, s)
            level.update(columns)
            late.update(later)
            sums[part, o] = F.expr(total)
    for stage in (level, late):
        rows = rows.withColumns(stage) if stage else rows
    rows = rows.withColumns(
        {f"_k_{o}": F.when(known[o].isNotNull(), _state("_rn", sums["n", o], sums["d", o], known[o])) for o in outs}
    ).drop(*level, *late)

    states = rows.groupBy(*keys, "_blk").agg(
        *[F.max(f"_k_{o}").alias(f"_e_{o}") for o in outs],
        *[F.min(F.when(F.col(f"_k_{o}").isNotNull(), _first(F.col(f"_k_{o}")))).alias(f"_w_{o}") for o in outs],
    )
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    ends, starts, firsts = {}, {}, {}
    for o, s in outs.items():
        e = F.col(f"_e_{o}")
        last = math.ceil(ema_history(s.alpha) / size) + 1
        among = Window.partitionBy(*keys, e.isNull()).orderBy("_blk").rowsBetween(-last, 0)
        ends[f"_e_{o}"] = F.when(e.isNotNull(), F.struct(F.collect_list(e).over(among).alias("l"), e.alias("e")))
        firsts[f"_w_{o}"] = F.min(f"_w_{o}").over(Window.partitionBy(*keys))
        starts[f"_a_{o}"] = F.last(_together(F.col(f"_e_{o}"), s), True).over(
            by_block.rowsBetween(Window.unboundedPreceding, -1)
        )
    states = states.withColumns(ends).withColumns(starts | firsts)
    states = states.select(*keys, "_blk", *starts, *firsts)
    rows = null_safe_join(rows, states, [*keys, "_blk"])

    exact, final = {}, {}
    for o, s in outs.items():
        k, a, w = F.col(f"_k_{o}"), F.col(f"_a_{o}"), F.col(f"_w_{o}")
        decay = s.kept(k["rn"] - a["rn"])
        n = k["n"] + F.coalesce(a["n"] * decay, F.lit(0.0))
        d = k["d"] + F.coalesce(a["d"] * decay, F.lit(0.0))
        exact[f"_y_{o}"] = _average(s, k["rn"], n, d, w)
        final[o] = F.coalesce(
            F.expr(f"last_value(`_y_{o}`, true) {fr.over_rows(None, 0)}"), _average(s, a["rn"], a["n"], a["d"], w)
        )
    temporary = [f"_{p}_{o}" for p in "kawy" for o in outs] + [f"_{p}_{o}" for p in "xf" for o in seeded]
    return rows.withColumns(exact).withColumns(final).drop(*temporary, "_blk", "_own", "_sub")


def _state(rn: str, n: Column, d: Column, x: Column) -> Column:
    return F.struct(F.col(rn).alias("rn"), n.alias("n"), d.alias("d"), x.alias("x"))


def _first(known: Column) -> Column:
    return F.struct(known["rn"].alias("rn"), known["x"].alias("x"))


def _together(known: Column, s: Smooth) -> Column:
    """State at the end of a block (``e``) with those before it (``l``, its own included)."""

    def total(part: str) -> Column:
        return F.aggregate(
            known["l"],
            F.lit(0.0),
            lambda sum_, k: sum_ + k[part] * s.kept(known["e"]["rn"] - k["rn"]),
        )

    return F.when(
        known.isNotNull(),
        F.struct(known["e"]["rn"].alias("rn"), total("n").alias("n"), total("d").alias("d")),
    )


def _average(s: Smooth, rn: Column, n: Column, d: Column, first: Column) -> Column:
    """Average at a known row from its weighted sum and weight; the first known row weighs 1."""
    if s.adjusted:
        return n / d
    rest = s.kept(rn - first["rn"] + 1)
    return F.when(rn == first["rn"], first["x"]).otherwise(
        (s.alpha * n + rest * first["x"]) / (s.alpha * d + rest)
    )


def ema_step(outs: Mapping[str, Smooth], name="ema", back: int = 0) -> Step:
    """Step computing exponential averages; ``back`` is the history of the sources."""
    reads = dict.fromkeys(s.source for s in outs.values())
    found = recursive_step([Phase(outs=outs)], tuple(reads), name)
    return Step(found.build, found.back + back, 0, name, found.reads, found.phases)
