"""Position sizing, stops, limits and drawdown as expressions over signal and position tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import div
from barloom.operators.metrics import count_if
from barloom.plans.ordered import null_safe_join, running


@dataclass(frozen=True)
class RiskLimits:
    """The default limits."""

    max_position_pct: float = 0.02
    min_position: float = 100.0
    stop_pct: float = 0.01
    profit_pct: float = 0.02
    atr_multiple: float = 2.0
    risk_reward: float = 2.0
    max_positions: int = 5
    max_portfolio_risk: float = 0.10
    max_drawdown: float = 0.10
    emergency_drawdown: float = 0.15
    trailing_pct: float = 0.005
    confidence_scaling: bool = True


def position_size(
    price="price", confidence="confidence", portfolio="portfolio_value", *, limits=RiskLimits(), method="percentage", atr="atr"
) -> Column:
    """Units to buy; a portfolio or price that is not positive raises an error."""
    pv, px = F.col(portfolio), F.col(price)
    base = pv * limits.max_position_pct
    if limits.confidence_scaling:
        base = base * F.col(confidence)
    size = F.greatest(base, F.lit(limits.min_position)) / px
    budget = pv * limits.max_position_pct
    if method == "percentage":
        size = F.least(size, budget / (px * limits.stop_pct))
    elif method == "atr":
        size = F.least(size, div(budget, F.col(atr) * limits.atr_multiple))
    bad = (pv <= 0) | (px <= 0)
    error = F.raise_error(F.lit("portfolio value and price must be positive")).cast("double")
    return F.when(bad, error).otherwise(F.round(size, 2))


def _side(distance: Column, entry: Column, kind: Column, up_for_long: bool) -> Column:
    long = kind == "long"
    sign = F.when(long, 1.0).otherwise(-1.0) * (1.0 if up_for_long else -1.0)
    return F.round(entry + distance * sign, 4)


def stop_price(entry="entry_price", kind="position_type", *, limits=RiskLimits(), method="percentage", atr="atr") -> Column:
    e = F.col(entry)
    if method in ("percentage", "fixed"):
        d = e * limits.stop_pct
    elif method == "atr":
        d = F.col(atr) * limits.atr_multiple
    else:
        raise ValueError(f"unknown stop method: {method}")
    return _side(d, e, F.col(kind), up_for_long=False)


def profit_price(
    entry="entry_price", kind="position_type", stop="stop_price", *, limits=RiskLimits(), method="percentage", atr="atr"
) -> Column:
    e = F.col(entry)
    if method == "percentage":
        d = e * limits.profit_pct
    elif method == "atr":
        d = F.col(atr) * limits.atr_multiple * limits.risk_reward
    else:
        d = F.abs(e - F.col(stop)) * limits.risk_reward
    return _side(d, e, F.col(kind), up_for_long=True)


# ------------------------------------------------------------------------- portfolio limits


def portfolio_state(positions: DataFrame, by: Sequence[str] = ("portfolio",), value="position_value", total="portfolio_value"):
    """Open positions, their share of the portfolio and the largest one's share."""
    agg = positions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("position_count"),
        F.sum(value).alias("_sum"),
        F.max(value).alias("_max"),
        F.max(total).alias(total),
    )
    pv = F.col(total)
    return agg.withColumns(
        {
            "total_risk": F.when(pv > 0, F.col("_sum") / pv).otherwise(0.0),
            "largest_position_pct": F.when(pv > 0, F.col("_max") / pv).otherwise(0.0),
        }
    ).drop("_sum", "_max")


def limit_violations(
    requests: DataFrame, state: DataFrame, by: Sequence[str] = ("portfolio",), *, limits=RiskLimits(), emergency: Column | None = None
) -> DataFrame:
    """Requests (size, price) with the limits they break as an array of structs, and whether they
    pass: only critical violations reject."""
    df = null_safe_join(requests, state, list(by)).fillna(0, ["position_count", "total_risk"])
    pv = F.col("portfolio_value")
    value = F.col("size") * F.col("price")
    share, total = value / pv, F.col("total_risk") + value / pv

    def violation(cond, kind, current, limit, severity):
        body = F.struct(
            F.lit(kind).alias("violation_type"),
            current.cast("double").alias("current_value"),
            F.lit(float(limit)).alias("limit_value"),
            F.lit(severity).alias("severity"),
        )
        return F.when(cond, body)

    many = F.col("position_count")
    stop = emergency if emergency is not None else F.lit(False)
    found = F.array(
        violation(many >= limits.max_positions, "max_positions", many, limits.max_positions, "critical"),
        violation(share > limits.max_position_pct, "position_size", share, limits.max_position_pct, "critical"),
        violation(total > limits.max_portfolio_risk, "portfolio_risk", total, limits.max_portfolio_risk, "warning"),
        violation(stop, "emergency_stop", F.lit(1.0), limits.emergency_drawdown, "critical"),
    )
    df = df.withColumn("violations", F.filter(found, lambda v: v.isNotNull()))
    accepted = ~F.exists("violations", lambda v: v["severity"] == "critical")
    return df.withColumn("accepted", accepted)


def violation_rows(checked: DataFrame, keep: Sequence[str]) -> DataFrame:
    return checked.select(*keep, F.explode("violations").alias("_v")).select(*keep, "_v.*")


def triggers(price="current_price", kind="position_type", stop="stop_price", profit="profit_price") -> dict[str, Column]:
    """Whether stop and target are reached; a missing level never is."""
    p, long = F.col(price), F.col(kind) == "long"
    s, t = F.col(stop), F.col(profit)
    return {
        "stop_hit": F.coalesce(F.when(long, p <= s).otherwise(p >= s), F.lit(False)),
        "target_hit": F.coalesce(F.when(long, p >= t).otherwise(p <= t), F.lit(False)),
    }


def trailing_stops(
    prices: DataFrame, *, keys=("position_id",), ts="ts", price="price", kind="position_type", start="stop_price", pct=0.005, width=None
) -> DataFrame:
    """Stop after each price: the initial stop, moved only in the position's favour. The levels
    are running extremes, so no state walks the rows."""
    long = F.col(kind) == "long"
    up = F.round(F.col(price) * (1 - pct), 4)
    down = F.round(F.col(price) * (1 + pct), 4)
    out = running(
        prices,
        {"_hi": ("max", F.when(long, up)), "_lo": ("min", F.when(~long, down))},
        keys=keys,
        order=ts,
        width=width,
    )
    moved = F.when(long, F.greatest("_hi", start)).otherwise(F.least("_lo", start))
    return out.withColumn("trailing_stop", moved).drop("_hi", "_lo")


# ---------------------------------------------------------------------------------- drawdown


def drawdown(equity: DataFrame, *, keys=("portfolio",), ts="ts", value="value", limits=RiskLimits(), ties=(), width=None) -> DataFrame:
    """Running peak, drawdown below it and the limits it breaks."""
    out = running(equity, {"peak": ("max", F.col(value))}, keys=keys, order=ts, ties=ties, width=width)
    dd = F.when(F.col("peak") > 0, (F.col("peak") - F.col(value)) / F.col("peak")).otherwise(0.0)
    return out.withColumns(
        {
            "drawdown": dd,
            "limit_breached": dd > limits.max_drawdown,
            "emergency": dd > limits.emergency_drawdown,
        }
    )


def max_drawdown_of(equity, *, keys=("portfolio",), ts="ts", value="value", ties=()) -> DataFrame:
    d = drawdown(equity, keys=keys, ts=ts, value=value, ties=ties)
    return d.groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"))


def risk_metrics(positions, equity, *, by=("portfolio",), ts="ts", value="value") -> DataFrame:
    """Current and deepest drawdown, total risk, count and largest share per portfolio."""
    d = drawdown(equity, keys=by, ts=ts, value=value)
    dd = d.groupBy(*by).agg(
        F.max_by("drawdown", ts).alias("current_drawdown"), F.max("drawdown").alias("max_drawdown")
    )
    return null_safe_join(portfolio_state(positions, by), dd, list(by))


def recent_violations(violations: DataFrame, as_of: Column, hours: float = 24, ts="ts") -> DataFrame:
    """Violations of the last ``hours``, which may be a fraction."""
    seconds = F.lit(round(hours * 3600, 6)).cast("decimal(18,6)")
    zero = F.lit(0)
    return violations.filter(F.col(ts) >= as_of - F.make_dt_interval(zero, zero, zero, seconds))


def purge_violations(violations: DataFrame, as_of: Column, days: int = 7, ts="ts") -> DataFrame:
    """Violations young enough to keep."""
    return violations.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def violation_counts(violations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sev = F.col("severity")
    return violations.groupBy(*by, "violation_type").agg(
        count_if(sev == "critical").alias("critical"), count_if(sev == "warning").alias("warnings")
    )
