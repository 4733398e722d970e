"""Classifiers on feature tables with Spark ML: distributed fits, scores as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.metrics import confusion, with_scores
from barloom.session import durable

NOT_FEATURES = ("symbol", "ts", "open", "high", "low", "close", "volume", "split", "fold", "role", "weight")


def feature_columns(df: DataFrame, label="label", exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    """Numeric columns that are neither the label nor excluded."""
    skip = {label, *exclude}
    return [f.name for f in df.schema if f.name not in skip and isinstance(f.dataType, T.NumericType)]


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing or non-finite values per feature."""
    bad = [
        F.count(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1)).alias(c) for c in columns
    ]
    return df.agg(*bad).unpivot([], list(columns), "feature", "missing")


def label_check(df: DataFrame, label="label", by: Sequence[str] = ()) -> DataFrame:
    """Whether the label is binary and both classes occur."""
    n = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(
        F.sum("_n").alias("rows"),
        F.count(label).alias("classes"),
        (F.min(F.col(label).isin(0, 1).cast("int")) == 1).alias("is_binary"),
    )


def feature_matrix(df: DataFrame, columns: Sequence[str], label="label", keep: Sequence[str] = ()) -> DataFrame:
    """Assembled vector and label; rows with missing features are left out."""
    ready = df.na.drop(subset=[*columns, label])
    vec = VectorAssembler(inputCols=list(columns), outputCol="features").transform(ready)
    return vec.select(*keep, "features", F.col(label).cast("double").alias(label))


def balanced(df: DataFrame, label="label") -> DataFrame:
    """Weight column: positives count negatives / positives times."""
    n = df.agg(F.sum((F.col(label) == 0).cast("long")), F.sum((F.col(label) == 1).cast("long"))).first()
    ratio = float(n[0] or 0) / float(n[1]) if n[1] else 1.0
    return df.withColumn("weight", F.when(F.col(label) == 1, ratio).otherwise(1.0))


def classifier(kind="gbt", label="label", weight: str | None = None, seed=42, **params):
    """Boosted trees or a forest on the ``features`` vector."""
    cls = {"gbt": GBTClassifier, "forest": RandomForestClassifier}[kind]
    est = cls(featuresCol="features", labelCol=label, seed=seed, **params)
    return est.setWeightCol(weight) if weight else est


def fit(train: DataFrame, columns: Sequence[str], kind="gbt", label="label", weight=None, **params) -> PipelineModel:
    """Assembler and classifier as one pipeline, so raw tables can be scored. Rows with a missing
    feature or label are not learnt from."""
    whole = train.na.drop(subset=[*columns, label])
    vec = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[vec, classifier(kind, label, weight, **params)]).fit(whole)


def score(model, df: DataFrame, out="probability") -> DataFrame:
    """Probability of the positive class and prediction for every row; both are null where a feature
    is missing. A ``weight`` column is not carried on."""
    raw = df.drop("features", "probability", "prediction", "rawPrediction", "weight")
    known = F.lit(True)
    for c in model.stages[0].getInputCols():
        known &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    scored = model.transform(raw.withColumn("_known", known))
    p = F.when(F.col("_known"), vector_to_array("probability")[1])
    scored = scored.withColumns({"_p": p, "prediction": F.when(F.col("_known"), F.col("prediction"))})
    return scored.drop("features", "rawPrediction", "probability", "_known").withColumnRenamed("_p", out)


def importance_table(model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """Feature importances, one row per feature."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.getActiveSession().createDataFrame(
        list(zip(columns, values, strict=True)), "feature string, importance double"
    )


def select_by_importance(importance: DataFrame) -> DataFrame:
    """Features at or above the median importance (one row per feature: a small table)."""
    mid = importance.agg(F.median("importance").alias("_m"))
    return importance.crossJoin(F.broadcast(mid)).filter(F.col("importance") >= F.col("_m")).drop("_m")


def grid_search(
    folds: DataFrame,
    columns: Sequence[str],
    grid: Mapping[str, Sequence],
    *,
    kind="gbt",
    label="label",
    weight: str | None = None,
) -> DataFrame:
    """Mean F1 over the folds for each combination. ``folds`` has ``fold`` and ``role`` columns.
    Features are written once and every fit reads them from there; fits run one after another,
    each spread over the cluster."""
    keep = ["fold", "role", *([weight] if weight else [])]
    data = durable(feature_matrix(folds, columns, label, keep=keep))
    ids = [r[0] for r in data.select("fold").distinct().orderBy("fold").collect()]
    names, scored = list(grid), None
    combos = list(product(*grid.values()))
    for i, combo in enumerate(combos):
        for f in ids:
            part = data.filter(F.col("fold") == f)
            est = classifier(kind, label, weight, **dict(zip(names, combo, strict=True)))
            model = est.fit(part.filter("role = 'train'"))
            test = model.transform(part.filter("role = 'test'"))
            c = confusion(test, label=label).select(
                F.lit(i).alias("config_id"), F.lit(f).alias("fold"), "tn", "fp", "fn", "tp"
            )
            scored = c if scored is None else scored.unionByName(c)
    per_fold = with_scores(scored)
    mean = per_fold.groupBy("config_id").agg(
        F.avg("f1").alias("mean_f1"), F.avg("accuracy").alias("mean_accuracy"), F.count(F.lit(1)).alias("folds")
    )
    table = folds.sparkSession.createDataFrame(
        [(i, *c) for i, c in enumerate(combos)], ["config_id", *names]
    )
    return table.join(mean, "config_id")
