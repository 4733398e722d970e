"""Aggregation and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, W, bars, bars_sql, query, table, ticks
from barloom.catalog.windows import case
from barloom.operators import metrics as mt
from barloom.operators import ranking as rk
from barloom.plans.series import columns_step, over_series

# Every bar as a trade from open to close, held for as many candles as it has ticks.
TR_CTE = f"""{bars_sql()}, trades AS (SELECT symbol, ts AS entry_time, ts AS exit_time, open AS entry_price,
  close AS exit_price, (close - open) / open * 100 AS pnl_pct, close - open AS pnl_points,
  CASE WHEN open > low THEN (close - open) / (open - low) ELSE 0 END AS pnl_r,
  CAST(volume AS BIGINT) AS candles_held, CASE WHEN close > open THEN 1 ELSE 0 END AS win,
  CASE WHEN close > open THEN 'profit_target' WHEN close = low THEN 'stop_loss'
    WHEN volume >= 4 THEN 'max_holding' ELSE 'eod' END AS exit_reason FROM bars)"""
TRADES = "WITH " + TR_CTE


def bar_trades(spark, sf):
    o, c = F.col("open"), F.col("close")
    return bars(spark, sf).select(
        "symbol",
        F.col("ts").alias("entry_time"),
        F.col("ts").alias("exit_time"),
        o.alias("entry_price"),
        c.alias("exit_price"),
        ((c - o) / o * 100).alias("pnl_pct"),
        (c - o).alias("pnl_points"),
        F.when(o > F.col("low"), (c - o) / (o - F.col("low"))).otherwise(0.0).alias("pnl_r"),
        F.col("volume").cast("long").alias("candles_held"),
        (c > o).cast("int").alias("win"),
        F.when(c > o, "profit_target")
        .when(c == F.col("low"), "stop_loss")
        .when(F.col("volume") >= 4, "max_holding")
        .otherwise("eod")
        .alias("exit_reason"),
    )


AGG = """count(*) AS total_trades, sum(win) AS winning_trades, count(*) - sum(win) AS losing_trades,
  avg(win) * 100 AS win_rate, sum(pnl_pct) AS total_pnl, avg(pnl_pct) AS avg_pnl,
  coalesce(avg(pnl_pct) FILTER (win = 1), 0) AS avg_win, coalesce(avg(pnl_pct) FILTER (win = 0), 0) AS avg_loss,
  sum(pnl_pct) FILTER (win = 1) / abs(sum(pnl_pct) FILTER (win = 0)) AS profit_factor,
  avg(win) * avg(pnl_pct) FILTER (win = 1) + (1 - avg(win)) * avg(pnl_pct) FILTER (win = 0) AS expectancy,
  avg(candles_held) AS avg_holding, avg(pnl_r) AS avg_r"""


@query(
    "a1_trade_metrics",
    "symbol total_trades:i winning_trades:i losing_trades:i win_rate:d total_pnl:d4 avg_pnl:d avg_win:d avg_loss:d "
    "profit_factor:d expectancy:d avg_holding:d avg_r:d",
    TRADES + f"SELECT symbol, {AGG} FROM trades GROUP BY 1",
)
def a1(spark, sf):
    return mt.trade_metrics(bar_trades(spark, sf), ["symbol"])


@query(
    "a2_risk_summary",
    "symbol avg_r:d total_pnl:d4 max_drawdown:d4",
    TRADES
    + """, c AS (SELECT *, sum(pnl_pct) OVER w AS cum FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY exit_time ROWS UNBOUNDED PRECEDING)),
d AS (SELECT symbol, cum - max(cum) OVER w AS dd FROM c WINDOW w AS (PARTITION BY symbol ORDER BY exit_time ROWS UNBOUNDED PRECEDING))
SELECT * FROM (SELECT symbol, avg(pnl_r) AS avg_r, sum(pnl_pct) AS total_pnl FROM trades GROUP BY 1)
JOIN (SELECT symbol, min(dd) AS max_drawdown FROM d GROUP BY 1) USING (symbol)""",
)
def a2(spark, sf):
    return mt.risk_summary(bar_trades(spark, sf))


@query(
    "a3_exit_reasons",
    "symbol exit_reason n:i pct:d",
    TRADES
    + "SELECT symbol, exit_reason, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY symbol) AS pct FROM trades GROUP BY 1, 2",
)
def a3(spark, sf):
    return mt.breakdown(bar_trades(spark, sf), "exit_reason", ["symbol"])


@query(
    "a4_hourly_wins",
    "hour:i wins:i total:i rate:d",
    TRADES
    + "SELECT hour(entry_time) AS hour, sum(win) AS wins, count(*) AS total, sum(win) * 100.0 / count(*) AS rate FROM trades GROUP BY 1",
)
def a4(spark, sf):
    return mt.hourly_rate(bar_trades(spark, sf), F.col("win"), "entry_time")


@query(
    "a5_hourly_label_rate",
    "symbol hour:i wins:i total:i rate:d",
    TRADES
    + """SELECT symbol, hour(entry_time) AS hour, sum(win) AS wins, count(*) AS total, sum(win) * 100.0 / count(*) AS rate
FROM trades GROUP BY 1, 2 HAVING count(*) > 28""",
)
def a5(spark, sf):
    return mt.hourly_rate(bar_trades(spark, sf), F.col("win"), "entry_time", ["symbol"], min_count=28)


_SLICES = {
    "quick_exit": "candles_held <= 3",
    "open_entry": "hour(entry_time) * 60 + minute(entry_time) = 540",
    "stop_loss": "exit_reason = 'stop_loss'",
    "max_holding": "exit_reason = 'max_holding'",
}


@query(
    "a6_slices",
    "symbol slice n:i win_rate:d avg_pnl:d median_holding:d",
    TRADES
    + " UNION ALL ".join(
        f"SELECT symbol, '{n}' AS slice, count(*) AS n, avg(win * 100.0) AS win_rate, avg(pnl_pct) AS avg_pnl, "
        f"median(candles_held) AS median_holding FROM trades WHERE {c} GROUP BY 1"
        for n, c in _SLICES.items()
    ),
)
def a6(spark, sf):
    return mt.slices(bar_trades(spark, sf), entry_minute=540, by=["symbol"])


# Of runs, which may be empty: nothing lost is an infinite factor, nothing won is 0.
RUN_AGG = AGG.replace(
    "sum(pnl_pct) FILTER (win = 1) / abs(sum(pnl_pct) FILTER (win = 0)) AS profit_factor",
    """CASE WHEN abs(sum(pnl_pct) FILTER (win = 0)) > 0
    THEN coalesce(sum(pnl_pct) FILTER (win = 1), 0) / abs(sum(pnl_pct) FILTER (win = 0))
    WHEN count(*) > 0 THEN 'infinity'::DOUBLE END AS profit_factor""",
)
RUNS_LONG = """l AS (SELECT run, metric, v FROM (SELECT run, total_trades::DOUBLE AS total_trades, win_rate::DOUBLE AS win_rate,
    total_pnl::DOUBLE AS total_pnl, avg_pnl::DOUBLE AS avg_pnl, profit_factor::DOUBLE AS profit_factor,
    avg_holding::DOUBLE AS avg_holding FROM m)
  UNPIVOT INCLUDE NULLS (v FOR metric IN (total_trades, win_rate, total_pnl, avg_pnl, profit_factor, avg_holding)))"""


@query(
    "a7_compare_runs",
    "metric base:d4 quick:d4 quick_delta:d4",
    TRADES
    + f""", m AS (SELECT 'base' AS run, {RUN_AGG} FROM trades UNION ALL
  SELECT 'quick' AS run, {RUN_AGG} FROM trades WHERE candles_held <= 3),
{RUNS_LONG}
SELECT metric, max(v) FILTER (run = 'base') AS base, max(v) FILTER (run = 'quick') AS quick,
  max(v) FILTER (run = 'quick') - max(v) FILTER (run = 'base') AS quick_delta FROM l GROUP BY 1""",
)
def a7(spark, sf):
    t = bar_trades(spark, sf)
    return mt.compare_runs({"base": t, "quick": t.filter("candles_held <= 3")})


THREE = {"base": "true", "quick": "candles_held <= 3", "cheap": "entry_price < 20"}
CHANGES = ", ".join(
    f"max(v) FILTER (run = '{n}') AS {n}" for n in THREE
) + ", " + ", ".join(
    f"max(v) FILTER (run = '{n}') - max(v) FILTER (run = 'base') AS {n}_delta" for n in list(THREE)[1:]
)


@query(
    "a7_compare_three_runs",
    "metric base:d4 quick:d4 cheap:d4 quick_delta:d4 cheap_delta:d4",
    TRADES
    + ", m AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS run, {RUN_AGG} FROM trades WHERE {c}" for n, c in THREE.items())
    + f"""),
{RUNS_LONG}
SELECT metric, {CHANGES} FROM l GROUP BY 1""",
)
def a7_three(spark, sf):
    t = bar_trades(spark, sf)
    return mt.compare_runs({n: t.filter(c) for n, c in THREE.items()})


@query(
    "a8_signal_quality",
    "signal n:i win_rate:d",
    TRADES
    + """, f AS (SELECT win, CASE WHEN candles_held <= 2 THEN 1 ELSE 0 END AS quick, CASE WHEN entry_price < 20 THEN 1 ELSE 0 END AS cheap FROM trades)
SELECT 'quick' AS signal, count(*) AS n, avg(win * 100.0) AS win_rate FROM f WHERE quick = 1
UNION ALL SELECT 'cheap', count(*), avg(win * 100.0) FROM f WHERE cheap = 1""",
)
def a8(spark, sf):
    t = bar_trades(spark, sf).withColumns(
        {
            "quick": (F.col("candles_held") <= 2).cast("int"),
            "cheap": (F.col("entry_price") < 20).cast("int"),
        }
    )
    return mt.signal_quality(t, ["quick", "cheap"], ["win"])


LABELS = "WITH p AS (SELECT quality AS label, toxic AS prediction FROM labels)"
CONF_SQL = """count(*) FILTER (label <> 1 AND prediction <> 1) AS tn, count(*) FILTER (label <> 1 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction <> 1) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp"""
SCORE_SQL = """(tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision",
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"""


def label_predictions(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("quality").alias("label"), F.col("toxic").alias("prediction")
    )


@query("a9_confusion", "tn:i fp:i fn:i tp:i", LABELS + f"SELECT {CONF_SQL} FROM p")
def a9(spark, sf):
    return mt.confusion(label_predictions(spark, sf))


@query(
    "a10_scores",
    "accuracy:d precision:d recall:d f1:d",
    LABELS + f", c AS (SELECT {CONF_SQL} FROM p) SELECT {SCORE_SQL} FROM c",
)
def a10(spark, sf):
    return mt.with_scores(mt.confusion(label_predictions(spark, sf)))


@query(
    "a11_rates",
    "sensitivity:d specificity:d ppv:d npv:d fpr:d fnr:d",
    LABELS
    + f""", c AS (SELECT {CONF_SQL} FROM p) SELECT tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity,
  tp / (tp + fp) AS ppv, tn / (tn + fn) AS npv, fp / (fp + tn) AS fpr, fn / (fn + tp) AS fnr FROM c""",
)
def a11(spark, sf):
    return mt.with_rates(mt.confusion(label_predictions(spark, sf)))


# Next-bar direction as the label, the close's place in its range as the score.
PRED = BARS + f""", p0 AS (SELECT symbol AS model, ts, CASE WHEN lead(close) OVER w > close THEN 1 ELSE 0 END AS label,
  round(CASE WHEN high > low THEN (high - close) / (high - low) ELSE 0.5 END, 3) AS probability FROM bars {W}),
p AS (SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS prediction FROM p0)"""


def predictions(spark, sf):
    span = F.col("high") - F.col("low")
    step = columns_step(
        lambda f: {"label": F.coalesce(f.lead("close") > F.col("close"), F.lit(False)).cast("int")}, ahead=1
    )
    d = over_series(bars(spark, sf), step)
    prob = F.round(F.when(span > 0, (F.col("high") - F.col("close")) / span).otherwise(0.5), 3)
    d = d.select(F.col("symbol").alias("model"), "ts", "label", prob.alias("probability"))
    return d.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


AUC_SQL = """, rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY probability)
    + (count(*) OVER (PARTITION BY model, probability) - 1) / 2.0 AS r FROM p),
auc AS (SELECT model, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS roc_auc FROM rk GROUP BY 1)"""
AP_SQL = """, s AS (SELECT model, probability, sum(label) AS pos, count(*) AS n FROM p GROUP BY 1, 2),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY probability DESC ROWS UNBOUNDED PRECEDING) AS tp,
    sum(n) OVER (PARTITION BY model ORDER BY probability DESC ROWS UNBOUNDED PRECEDING) AS seen FROM s),
ap AS (SELECT model, sum(pos * tp / seen) / sum(pos) AS average_precision FROM cu GROUP BY 1)"""


@query("a12_roc_auc", "model roc_auc:d", PRED + AUC_SQL + " SELECT * FROM auc")
def a12(spark, sf):
    return mt.roc_auc(predictions(spark, sf), by=["model"])


@query("a13_average_precision", "model average_precision:d", PRED + AP_SQL + " SELECT * FROM ap")
def a13(spark, sf):
    return mt.average_precision(predictions(spark, sf), by=["model"])


@query(
    "a14_class_report",
    "class:i precision:d recall:d f1:d support:i",
    LABELS
    + """, k AS (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS said,
  count(*) FILTER (label = c AND prediction = c) AS tp FROM p, (VALUES (0), (1)) v(c) GROUP BY 1)
SELECT c AS "class", coalesce(tp / nullif(said, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2 * tp / nullif(said + support, 0), 0) AS f1, support FROM k""",
)
def a14(spark, sf):
    return mt.class_report(label_predictions(spark, sf))


THRESHOLDS = [0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]
SWEEP = (
    PRED
    + f""", c AS (SELECT model, threshold, count(*) FILTER (label <> 1 AND probability < threshold) AS tn,
  count(*) FILTER (label <> 1 AND probability >= threshold) AS fp,
  count(*) FILTER (label = 1 AND probability < threshold) AS fn,
  count(*) FILTER (label = 1 AND probability >= threshold) AS tp
  FROM p, (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) v(threshold) GROUP BY 1, 2),
sw AS (SELECT model, threshold, {SCORE_SQL} FROM c)"""
)


@query(
    "a15_threshold_sweep",
    "model threshold:d accuracy:d precision:d recall:d f1:d",
    SWEEP + " SELECT * FROM sw",
)
def a15(spark, sf):
    return mt.threshold_sweep(predictions(spark, sf), THRESHOLDS, by=["model"])


@query(
    "a15_best_threshold",
    "model threshold:d f1:d",
    SWEEP + " SELECT * FROM sw QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) = 1",
)
def a15b(spark, sf):
    return mt.best_threshold(mt.threshold_sweep(predictions(spark, sf), THRESHOLDS, by=["model"]), ["model"])


@query(
    "a16_model_table",
    "model accuracy:d precision:d recall:d f1:d roc_auc:d average_precision:d",
    PRED
    + AUC_SQL
    + AP_SQL
    + f", c AS (SELECT model, {CONF_SQL} FROM p GROUP BY 1) SELECT model, {SCORE_SQL}, roc_auc, average_precision "
    "FROM c JOIN auc USING (model) JOIN ap USING (model)",
)
def a16(spark, sf):
    return mt.model_table(predictions(spark, sf))


PARTED = PRED + ", q AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-25' THEN 'train' ELSE 'test' END AS split FROM p)"


@query(
    "a17_split_gap",
    "model accuracy_gap:d f1_gap:d accuracy_overfit f1_overfit",
    PARTED
    + f""", c AS (SELECT model, split, {CONF_SQL} FROM q GROUP BY 1, 2),
s AS (SELECT model, split, {SCORE_SQL} FROM c),
g AS (SELECT model, max(accuracy) FILTER (split = 'train') - max(accuracy) FILTER (split = 'test') AS accuracy_gap,
  max(f1) FILTER (split = 'train') - max(f1) FILTER (split = 'test') AS f1_gap FROM s GROUP BY 1)
SELECT *, accuracy_gap > 0.1 AS accuracy_overfit, f1_gap > 0.1 AS f1_overfit FROM g""",
)
def a17(spark, sf):
    p = predictions(spark, sf)
    early = F.col("ts") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    p = p.withColumn("split", F.when(early, "train").otherwise("test"))
    return mt.split_gap(mt.with_scores(mt.confusion(p, by=["model", "split"])))


COLS = ("open", "high", "low", "close", "volume")


@query(
    "a18_correlations",
    "symbol a b corr:d",
    BARS
    + " UNION ALL ".join(
        f"SELECT symbol, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM bars GROUP BY 1"
        for i, a in enumerate(COLS)
        for b in COLS[i + 1 :]
    ),
)
def a18(spark, sf):
    return mt.correlations(bars(spark, sf), COLS, ["symbol"])


@query(
    "a18_correlated_pairs",
    "a b",
    BARS
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM bars"
        for i, a in enumerate(COLS)
        for b in COLS[i + 1 :]
    )
    + ") WHERE abs(c) > 0.5",
)
def a18b(spark, sf):
    return mt.correlated_pairs(bars(spark, sf), COLS, 0.5)


# Spread of a column as its weight: an importance table derived from the bars.
IMP = BARS + ", imp AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, stddev_samp({c}) AS importance FROM bars" for c in COLS
) + ")"


def importances(spark, sf):
    one = bars(spark, sf).agg(*[F.stddev_samp(c).alias(c) for c in COLS])
    return one.unpivot([], list(COLS), "feature", "importance")


@query(
    "a19_importance_by_category",
    "category total:d features:i mean:d",
    IMP
    + """SELECT CASE WHEN feature IN ('open', 'close') THEN 'price' WHEN feature IN ('high', 'low') THEN 'range' ELSE 'other' END AS category,
  sum(importance) AS total, count(*) AS features, avg(importance) AS mean FROM imp GROUP BY 1""",
)
def a19(spark, sf):
    return mt.importance_by_category(importances(spark, sf), {"price": "open|close", "range": "high|low"})


@query(
    "a20_class_weight",
    "model negatives:i positives:i scale_pos_weight:d",
    PRED
    + """SELECT model, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives,
  count(*) FILTER (label = 0) / count(*) FILTER (label = 1) AS scale_pos_weight FROM p GROUP BY 1""",
)
def a20(spark, sf):
    return mt.class_weight(predictions(spark, sf), by=["model"])


@query(
    "w34_cumulative_importance",
    "feature rank:i share:d cumulative_share:d",
    IMP
    + """SELECT feature, row_number() OVER (ORDER BY importance DESC) AS rank, importance / sum(importance) OVER () AS share,
  sum(importance) OVER (ORDER BY importance DESC ROWS UNBOUNDED PRECEDING) / sum(importance) OVER () AS cumulative_share FROM imp""",
)
def w34(spark, sf):
    return rk.rank_features(importances(spark, sf))


@query(
    "k1_best_and_worst",
    "side symbol entry_time pnl_pct:d",
    TRADES
    + """SELECT * FROM (SELECT 'best' AS side, symbol, entry_time, pnl_pct FROM trades ORDER BY pnl_pct DESC, symbol, entry_time LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'worst', symbol, entry_time, pnl_pct FROM trades ORDER BY pnl_pct, symbol, entry_time LIMIT 5)""",
)
def k1(spark, sf):
    return rk.best_and_worst(bar_trades(spark, sf), 5, ties=["symbol", "entry_time"])


# Each (symbol, hour) as one configuration of a sweep.
CONFIGS = TRADES + f", cfg AS (SELECT symbol || '-' || hour(entry_time) AS config_id, {AGG} FROM trades GROUP BY 1)"


def configs(spark, sf):
    name = F.concat_ws("-", "symbol", F.hour("entry_time"))
    return mt.trade_metrics(bar_trades(spark, sf).withColumn("config_id", name), ["config_id"])


@query(
    "k2_top_configs",
    "metric rank:i config_id value:d4",
    CONFIGS
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{m}' AS metric, row_number() OVER (ORDER BY {m} DESC, config_id) AS rank, config_id, {m} AS value FROM cfg WHERE total_trades >= 25) WHERE rank <= 10"
        for m in ("total_pnl", "profit_factor", "win_rate")
    ),
)
def k2(spark, sf):
    return rk.top_configs(configs(spark, sf), ["total_pnl", "profit_factor", "win_rate"], 10, min_trades=25)


@query(
    "k3_best_balanced",
    "config_id score:d4",
    CONFIGS
    + "SELECT config_id, total_pnl * 0.4 + profit_factor * 3.0 + win_rate * 0.3 AS score FROM cfg ORDER BY score DESC, config_id LIMIT 1",
)
def k3(spark, sf):
    return rk.best_balanced(configs(spark, sf))


@query(
    "k4_top_features",
    "feature rank:i importance:d",
    IMP + "SELECT feature, row_number() OVER (ORDER BY importance DESC) AS rank, importance FROM imp QUALIFY rank <= 3",
)
def k4(spark, sf):
    return rk.rank_features(importances(spark, sf), 3)


@query(
    "k5_sorted_by_time",
    "symbol ts value:d",
    "SELECT event_type AS symbol, ts, value FROM events ORDER BY symbol, ts, event_id",
)
def k5(spark, sf):
    return rk.sorted_by_time(ticks(spark, sf), ties=["ingest_id"])
