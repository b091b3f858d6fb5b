"""Model selection and inference on feature tables with MLlib: registry, folds, search, calibration, thresholds, prediction."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation as V

# Ranges that a search draws from.  Boosted trees stand in for the usual external library and are another learner.
SPACES: dict[str, dict[str, list]] = {
    "lr": {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "rf": {"numTrees": [20, 50, 100], "maxDepth": [3, 5, 8]},
    "gbt": {"maxIter": [10, 20, 40], "maxDepth": [2, 3, 5], "stepSize": [0.05, 0.1, 0.3]},
    "svm": {"regParam": [0.001, 0.01, 0.1, 1.0]},
}
LEARNERS: dict[str, Callable] = {"lr": LogisticRegression, "rf": RandomForestClassifier, "gbt": GBTClassifier, "svm": LinearSVC}


def pipeline(kind: str, features: list[str], label: str, **parameters) -> Pipeline:
    if kind not in LEARNERS:
        raise ValueError(f"unknown model {kind}")
    stages = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="error"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    learner = LEARNERS[kind](featuresCol="_x", labelCol=label, predictionCol="_p", **parameters)
    # Not every learner takes it as an argument.
    return Pipeline(stages=[*stages, learner.setRawPredictionCol("_margin")])


def probabilities(model: PipelineModel, df: DataFrame, name: str = "prob") -> DataFrame:
    """``df`` with the probability of label 1; a margin goes through the logistic function."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(-vector_to_array("_margin")[1]))
    return out.select(*df.columns, p.alias(name))


def settings(kind: str, trials: int | None = None, seed: int = 42, fixed: dict | None = None) -> list[dict]:
    """The grid of a model's space, or ``trials`` random points of it; ``fixed`` values are not searched."""
    space = {k: v for k, v in SPACES[kind].items() if k not in (fixed or {})}
    grid = [dict(zip(space, v, strict=True)) | (fixed or {}) for v in itertools.product(*space.values())]
    return grid if trials is None or trials >= len(grid) else random.Random(seed).sample(grid, trials)


def cross_validate(df: DataFrame, fold: str, kind: str, features: list[str], label: str, parameters: dict) -> DataFrame:
    """(fold, roc_auc, threshold, and metrics) of models fitted on all other folds, thresholds chosen on the training rows."""
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        train, valid = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        model = pipeline(kind, features, label, **parameters).fit(train)
        cut = V.roc_operating_point(V.curve(probabilities(model, train), "prob", label)).first().threshold
        scored = probabilities(model, valid)
        auc = V.roc_auc(V.curve(scored, "prob", label))
        row = V.confusion(scored, "prob", label, cut).crossJoin(F.broadcast(auc))  # one row each
        row = row.select(F.lit(k).alias("fold"), F.lit(cut).alias("threshold"), "roc_auc", "accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy")
        out = row if out is None else out.union(row)
    return out


def search(df: DataFrame, fold: str, kind: str, features: list[str], label: str, trials: int | None = 4, seed: int = 42) -> tuple[dict, DataFrame]:
    """(best setting, its fold results): the highest mean of F1 and area under the ROC curve over the folds."""
    best = None
    for s in settings(kind, trials, seed):
        rows = [r.asDict() for r in cross_validate(df, fold, kind, features, label, s).collect()]  # a row for each fold
        value = sum((r["f1"] or 0) + (r["roc_auc"] or 0) for r in rows) / (2 * len(rows))
        if best is None or value > best[0]:
            best = (value, s, rows)
    return best[1], df.sparkSession.createDataFrame(best[2])


def nested(df: DataFrame, outer: str, inner: str, kind: str, features: list[str], label: str, trials: int = 2) -> DataFrame:
    """(outer_fold, setting, metrics): in each outer fold a search over the inner folds of its training rows, then the chosen model on its test rows."""
    out = None
    for k in sorted(r[0] for r in df.select(outer).distinct().collect()):
        train, test = df.where(F.col(outer) != k), df.where(F.col(outer) == k)
        chosen, _ = search(train, inner, kind, features, label, trials)
        model = pipeline(kind, features, label, **chosen).fit(train)
        cut = V.roc_operating_point(V.curve(probabilities(model, train), "prob", label)).first().threshold
        row = V.confusion(probabilities(model, test), "prob", label, cut).select(F.lit(k).alias("outer_fold"), F.lit(str(sorted(chosen.items()))).alias("setting"), F.lit(cut).alias("threshold"), "accuracy", "f1", "balanced_accuracy")
        out = row if out is None else out.union(row)
    return out


def average_settings(results: DataFrame, numeric: Iterable[str], weight: str | None = None) -> DataFrame:
    """Mean (or weighted mean) of numeric settings over folds."""
    w = F.col(weight) if weight else F.lit(1.0)
    return results.agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in numeric])


def calibrate(df: DataFrame, prob: str, label: str, method: str = "sigmoid") -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``calibrated``: logistic in the log odds, or isotonic in the probability."""
    p = F.greatest(F.least(F.col(prob), F.lit(1 - 1e-6)), F.lit(1e-6))
    if method == "sigmoid":
        assemble = VectorAssembler(inputCols=["_odds"], outputCol="_o")
        odds = lambda d: assemble.transform(d.withColumn("_odds", F.log(p / (1 - p))))
        model = LogisticRegression(featuresCol="_o", labelCol=label, probabilityCol="_c").fit(odds(df))
        return lambda d: model.transform(odds(d)).select(*d.columns, vector_to_array("_c")[1].alias("calibrated"))
    if method == "isotonic":
        assemble = VectorAssembler(inputCols=[prob], outputCol="_o")
        iso = IsotonicRegression(featuresCol="_o", labelCol=label, predictionCol="calibrated").fit(assemble.transform(df))
        return lambda d: iso.transform(assemble.transform(d)).select(*d.columns, "calibrated")
    raise ValueError(f"unknown calibration {method}")


def predict(df: DataFrame, model: PipelineModel, features: list[str], key: str, night: str, level: str = "patient", night_threshold: float = 0.5, patient_threshold: float = 0.5) -> DataFrame:
    """Night rows (key, night, prob, pred), or votes by patient; a missing feature is an error."""
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"features are missing: {missing}")
    nights = probabilities(model, df).select(key, night, "prob", (F.col("prob") >= night_threshold).cast("int").alias("pred"))
    if level == "night":
        return nights
    votes = V.patient_votes(nights.withColumn("_y", F.lit(0)), key, "prob", "_y", night_threshold, patient_threshold)
    return votes.drop("labels", "ground_truth")


def feature_names(local: list[str], aggregates: list[str], global_: list[str], order: str = "feature") -> list[str]:
    """Names of the night matrix: each local feature under each aggregate, feature-major or aggregate-major, then the global ones."""
    pairs = [(f, a) for f in local for a in aggregates] if order == "feature" else [(f, a) for a in aggregates for f in local]
    return [f"{f}_{a}" for f, a in pairs] + list(global_)
