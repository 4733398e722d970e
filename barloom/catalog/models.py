"""Split, fold and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, W, bars, query
from barloom.catalog.metrics import PRED, predictions
from barloom.functions import scalars as sc
from barloom.operators import metrics as mt
from barloom.operators import models as md
from barloom.operators import splits as sp
from barloom.operators import windows as wi
from barloom.plans.series import columns_step, over_series

NUM = PRED + """, z AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts) - 1 AS pos,
  count(*) OVER (PARTITION BY model) AS n FROM p)"""
K = {"keys": ["model"]}


@query(
    "m1_chronological_split",
    "model ts label:i split",
    NUM + "SELECT model, ts, label, CASE WHEN pos < floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM z",
)
def m1(spark, sf):
    return sp.chronological_split(predictions(spark, sf), **K)


@query(
    "m1_split_time",
    "model split_ts",
    NUM + "SELECT model, min(ts) AS split_ts FROM z WHERE pos >= floor(n * (1 - 0.2::DOUBLE)) GROUP BY 1",
)
def m1b(spark, sf):
    return sp.split_time(sp.chronological_split(predictions(spark, sf), **K), **K)


@query(
    "m2_three_way_split",
    "model ts split",
    NUM
    + f"""SELECT model, ts, CASE WHEN pos < floor(n * {0.7!r}::DOUBLE) THEN 'train' WHEN pos < floor(n * {0.7 + 0.15!r}::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM z""",
)
def m2(spark, sf):
    return sp.three_way_split(predictions(spark, sf), **K)


@query(
    "m3_validate_split",
    "model rows:i train_rows:i test_rows:i train_classes:i test_classes:i is_valid n_errors:i n_warnings:i",
    NUM
    + """, s AS (SELECT *, pos < floor(n * (1 - 0.2::DOUBLE)) AS tr FROM z)
SELECT model, count(*) AS rows, count(*) FILTER (tr) AS train_rows, count(*) FILTER (NOT tr) AS test_rows,
  count(DISTINCT label) FILTER (tr) AS train_classes, count(DISTINCT label) FILTER (NOT tr) AS test_classes,
  true AS is_valid, 0 AS n_errors,
  (count(DISTINCT label) FILTER (tr) <> count(DISTINCT label) FILTER (NOT tr))::INT AS n_warnings FROM s GROUP BY 1""",
)
def m3(spark, sf):
    p = predictions(spark, sf)
    v = sp.validate_split(sp.chronological_split(p, **K), p, **K)
    return v.withColumns({"n_errors": F.size("errors"), "n_warnings": F.size("warnings")})


@query(
    "m4_expanding_folds",
    "model fold:i role rows:i start end",
    NUM
    + """, f AS (SELECT z.*, i AS fold, n - (n // 4) * (3 - i) AS e, n // 4 AS size FROM z, (VALUES (0), (1), (2)) v(i)),
g AS (SELECT *, CASE WHEN pos < e THEN 'train' WHEN pos < e + size THEN 'test' END AS role FROM f)
SELECT model, fold, role, count(*) AS rows, min(ts) AS start, max(ts) AS "end" FROM g WHERE role IS NOT NULL GROUP BY 1, 2, 3""",
)
def m4(spark, sf):
    return sp.fold_sizes(sp.expanding_folds(predictions(spark, sf), 3, **K), **K)


@query(
    "m5_walk_forward_folds",
    "model fold:i role rows:i start end",
    NUM
    + """, f AS (SELECT z.*, i AS fold, (n // 6) * (i + 1) + n - (n // 6) * 6 AS e, n // 6 AS size
  FROM z, (VALUES (0), (1), (2), (3), (4)) v(i)),
g AS (SELECT *, CASE WHEN pos < e - e // 5 THEN 'train' WHEN pos < e THEN 'val' WHEN pos < e + size THEN 'test' END AS role FROM f)
SELECT model, fold, role, count(*) AS rows, min(ts) AS start, max(ts) AS "end" FROM g WHERE role IS NOT NULL GROUP BY 1, 2, 3""",
)
def m5(spark, sf):
    return sp.fold_sizes(sp.walk_forward_folds(predictions(spark, sf), 5, **K), **K)


@query(
    "a21_split_report",
    "model split rows:i positives:i negatives:i ratio:d start end",
    NUM
    + """, s AS (SELECT *, CASE WHEN pos < floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM z)
SELECT model, split, count(*) AS rows, sum(label) AS positives, count(*) - sum(label) AS negatives,
  count(*) / any_value(n) AS ratio, min(ts) AS start, max(ts) AS "end" FROM s GROUP BY 1, 2""",
)
def a21(spark, sf):
    return sp.split_report(sp.chronological_split(predictions(spark, sf), **K), by=["model"])


FEATURES = ["body_size", "rng", "volatility_5", "volume_ratio", "stoch_k"]


def feature_table(spark, sf):
    """Bars with a few features and the next bar's direction as the label."""
    label = columns_step(
        lambda f: {"label": F.coalesce(f.lead("close") > F.col("close"), F.lit(False)).cast("int")}, ahead=1
    )
    d = over_series(
        bars(spark, sf),
        wi.strong_candle((5,)),
        wi.volatility((5,)),
        wi.volume_features(5, 10),
        wi.stochastic(5, 3),
        label,
    )
    return d.withColumn("rng", sc.range_pct()).select("symbol", "ts", "label", *FEATURES)


@query(
    "m6_null_audit",
    "feature missing:i",
    BARS
    + f"""SELECT 'ret' AS feature, count(*) - count(ret) AS missing FROM (SELECT close / lag(close) OVER w - 1 AS ret FROM bars {W})
UNION ALL SELECT 'volume', count(*) - count(volume) FROM bars""",
)
def m6(spark, sf):
    d = over_series(
        bars(spark, sf), columns_step(lambda f: {"ret": wi.pct_change(f, "close")}, back=1)
    )
    return md.null_audit(d, ["ret", "volume"])


@query(
    "m6_label_check",
    "model rows:i classes:i is_binary",
    PRED + "SELECT model, count(*) AS rows, count(DISTINCT label) AS classes, true AS is_binary FROM p GROUP BY 1",
)
def m6b(spark, sf):
    return md.label_check(predictions(spark, sf), by=["model"])


@query("m6_feature_matrix", None, None)
def m6c(spark, sf):
    m = md.feature_matrix(feature_table(spark, sf), FEATURES, keep=["symbol", "ts"])
    from pyspark.ml.functions import vector_to_array

    return m.select("symbol", "ts", "label", vector_to_array("features").alias("features"))


# Position and split of each bar; its features are known from the sixth bar of a symbol on.
SPLIT_SQL = (
    BARS
    + f""", z AS (SELECT symbol, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n,
  coalesce(lead(close) OVER w > close, false) AS up FROM bars {W}),
s AS (SELECT *, CASE WHEN rn - 1 < floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM z)
"""
)
SCORED_SQL = SPLIT_SQL + """SELECT symbol, split, count(*) AS rows, count(*) FILTER (up) AS positives,
  count(*) FILTER (rn >= 6) AS scored, true AS in_range, true AS learnt FROM s GROUP BY 1, 2"""
SCORED = "symbol split rows:i positives:i scored:i in_range learnt"
#: Least area under the curve on the rows learnt from; a model that scores at random has 0.5.
AUC_FLOOR = 0.58


def split_table(spark, sf):
    return sp.chronological_split(feature_table(spark, sf))


def fitted(table, kind="forest", **kw):
    """Trained on the first four fifths of each symbol's bars."""
    train = md.balanced(table.filter("split = 'train'").na.drop())
    return md.fit(train, FEATURES, kind, weight="weight", **kw)


def scored(table, model):
    """Rows, scored rows and range of the scores per symbol and part, and whether the model tells the
    classes apart on what it learnt from."""
    p = F.col("probability")
    rows = md.score(model, table)
    auc = mt.roc_auc(rows.filter("split = 'train' AND probability IS NOT NULL"))
    digest = rows.groupBy("symbol", "split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("label").alias("positives"),
        F.count(p).alias("scored"),
        F.bool_and(p.between(0, 1)).alias("in_range"),
    )
    return digest.crossJoin(F.broadcast(auc)).withColumn("learnt", F.col("roc_auc") >= AUC_FLOOR)


@query("m7_forest_predictions", SCORED, SCORED_SQL)
def m7(spark, sf):
    d = split_table(spark, sf)
    return scored(d, fitted(d, "forest", numTrees=100, maxDepth=4))


@query("f11_boosted_tree_scores", SCORED, SCORED_SQL)
def f11(spark, sf):
    d = split_table(spark, sf)
    return scored(d, fitted(d, "gbt", maxIter=20, maxDepth=3))


@query("m7_forest_rows")
def m7_rows(spark, sf):
    """Probability and prediction of every row."""
    d = split_table(spark, sf)
    return md.score(fitted(d, "forest", numTrees=100, maxDepth=4), d)


@query("f11_boosted_tree_rows")
def f11_rows(spark, sf):
    d = split_table(spark, sf)
    return md.score(fitted(d, "gbt", maxIter=20, maxDepth=3), d)


@query(
    "m8_grid_search",
    "maxDepth:i numTrees:i folds:i in_range",
    " UNION ALL ".join(
        f"SELECT {d} AS \"maxDepth\", {n} AS \"numTrees\", 2 AS folds, true AS in_range" for d in (2, 4) for n in (10, 20)
    ),
)
def m8(spark, sf):
    folds = sp.expanding_folds(feature_table(spark, sf).na.drop(), 2)
    found = md.grid_search(folds, FEATURES, {"maxDepth": [2, 4], "numTrees": [10, 20]}, kind="forest")
    return found.withColumn("in_range", F.col("mean_f1").between(0, 1))


@query("m8_grid_search_means")
def m8_means(spark, sf):
    """Mean scores over the folds of every combination."""
    folds = sp.expanding_folds(feature_table(spark, sf).na.drop(), 2)
    return md.grid_search(folds, FEATURES, {"maxDepth": [2, 4], "numTrees": [10, 20]}, kind="forest")


@query("m9_chosen_features")
def m9_chosen(spark, sf):
    """The features at or above the median importance."""
    model = fitted(split_table(spark, sf), "forest", numTrees=100, maxDepth=4)
    return md.select_by_importance(md.importance_table(model, FEATURES))


@query("m9_select_by_importance", "enough", "SELECT true AS enough")
def m9(spark, sf):
    """Half of the features or more reach the median."""
    model = fitted(split_table(spark, sf), "forest", numTrees=100, maxDepth=4)
    kept = md.select_by_importance(md.importance_table(model, FEATURES))
    return kept.agg((F.count(F.lit(1)) * 2 >= len(FEATURES)).alias("enough"))


@query(
    "m10_importance_table",
    "feature in_range total:d",
    " UNION ALL ".join(f"SELECT '{f}' AS feature, true AS in_range, 1.0 AS total" for f in FEATURES),
)
def m10(spark, sf):
    model = fitted(split_table(spark, sf), "forest", numTrees=100, maxDepth=4)
    table = md.importance_table(model, FEATURES)
    total = table.agg(F.sum("importance").alias("total"))
    return table.crossJoin(F.broadcast(total)).withColumn("in_range", F.col("importance").between(0, 1))
