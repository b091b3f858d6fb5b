"""Training runs: group-wise calibration, nested runs that resume, evaluation files, and Boruta's choice of features.

Models are MLlib's; what is looped over on the driver are folds, settings and repeats, never rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.functions.shared import materialize, remove_tables

from . import evaluation as V
from . import learning as L
from . import results as R
from .cohort import group_folds
from .evaluation import running_totals
from .ranking import ranked
from .thresholds import pr_on_grid, roc_on_grid


def fit(df: DataFrame, kind: str, features: list[str], label: str, parameters: dict, group: str | None = None, patience_share: float | None = None, seed: int = 42) -> PipelineModel:
    """A fitted pipeline; boosted trees stop early where the loss on a share of the groups, chosen by hash, no longer falls."""
    if kind != "gbt" or not patience_share or group is None:
        return L.pipeline(kind, features, label, **parameters).fit(df)
    held = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(10_000)) < int(10_000 * patience_share)
    rows = df.withColumn("_held", held)
    sides = {r["_held"] for r in rows.select("_held").distinct().collect()}
    if sides != {True, False}:  # too few groups for a held share
        return L.pipeline(kind, features, label, **parameters).fit(df)
    return L.pipeline(kind, features, label, validationIndicatorCol="_held", **parameters).fit(rows)


@dataclass
class Calibrated:
    """Models of all folds, each with the calibrator fitted on the rows that its model has not seen."""

    parts: list[tuple[PipelineModel, Callable[[DataFrame], DataFrame]]]

    def transform(self, df: DataFrame, name: str = "prob") -> DataFrame:
        """``df`` with the mean of the calibrated probabilities."""
        out, names = df, []
        for i, (model, calibrator) in enumerate(self.parts):
            out = calibrator(L.probabilities(model, out, f"_raw{i}"))
            names.append(f"_c{i}")
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
        return out.select(*df.columns, mean.alias(name))


def calibrator(df: DataFrame, prob: str, label: str, method: str, weight: str | None, i: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``_c<i>``: logistic in the log odds, or isotonic, of the rows' weights."""
    more = {"weightCol": weight} if weight else {}
    if method == "sigmoid":
        p = F.greatest(F.least(F.col(prob), F.lit(1 - 1e-6)), F.lit(1e-6))
        assemble = VectorAssembler(inputCols=["_odds"], outputCol="_o")
        odds = lambda d: assemble.transform(d.withColumn("_odds", F.log(p / (1 - p))))
        model = LogisticRegression(featuresCol="_o", labelCol=label, probabilityCol="_pc", predictionCol="_pp", rawPredictionCol="_pr", **more).fit(odds(df))
        return lambda d: model.transform(odds(d)).select(*d.columns, vector_to_array("_pc")[1].alias(f"_c{i}"))
    if method == "isotonic":
        assemble = VectorAssembler(inputCols=[prob], outputCol="_o")
        model = IsotonicRegression(featuresCol="_o", labelCol=label, predictionCol=f"_c{i}", **more).fit(assemble.transform(df))
        return lambda d: model.transform(assemble.transform(d)).select(*d.columns, f"_c{i}")
    raise ValueError(f"unknown calibration {method}")


def calibrate_out_of_fold(df: DataFrame, group: str, kind: str, features: list[str], label: str, parameters: dict, *, folds: int = 3, method: str = "sigmoid", weight: str | None = None, seed: int = 42) -> Calibrated:
    """Models and calibrators by group folds: no group is both in a model's rows and in its calibrator's.

    Folds are stratified by the groups' labels.  A fold without rows of both labels on either side
    is left out; if none is left it is an error.
    """
    dealt = df.join(group_folds(df, group, label, folds, seed).select(group, F.col("fold").alias("_fold")), group)
    # A row for each fold: which labels it holds.
    held = {r["_fold"]: set(r["ys"]) for r in dealt.groupBy("_fold").agg(F.collect_set(label).alias("ys")).collect()}
    parts = []
    for k in sorted(held):
        others = set().union(*(ys for f, ys in held.items() if f != k), set())
        if len(held[k]) < 2 or len(others) < 2:
            continue
        model = fit(dealt.where(F.col("_fold") != k).drop("_fold"), kind, features, label, parameters)
        unseen = L.probabilities(model, dealt.where(F.col("_fold") == k), f"_raw{k}")
        parts.append((model, unseen, k))
    if not parts:
        raise ValueError("no fold has rows of both labels")
    # Named by their place, as transform() names them.
    return Calibrated([(m, calibrator(u.withColumnRenamed(f"_raw{k}", f"_raw{i}"), f"_raw{i}", label, method, weight, i)) for i, (m, u, k) in enumerate(parts)])


def level_metrics(scored: DataFrame, group: str, label: str, threshold: float, patient_threshold: float) -> DataFrame:
    """(level, the seven metrics, mean, sd) of scored nights, and of patients by the mean of their nights' probabilities."""
    nights = V.metric_suite(scored, "prob", label, threshold).select(F.lit("night").alias("level"), "*")
    votes = V.patient_votes(scored, group, "prob", label, threshold, patient_threshold).select(F.col("mean_prob").alias("prob"), F.col("ground_truth").alias(label))
    return nights.union(V.metric_suite(votes, "prob", label, patient_threshold).select(F.lit("patient").alias("level"), "*"))


def search_folds(train: DataFrame, group: str, kind: str, features: list[str], label: str, inner: int, seed: int, trials: int | None) -> dict:
    """The setting of the highest mean of F1 and area under the ROC curve over stratified group folds."""
    dealt = materialize(train.join(group_folds(train, group, label, inner, seed).select(group, F.col("fold").alias("_inner")), group), "inner")
    chosen, _ = L.search(dealt, "_inner", kind, features, label, trials, seed)
    remove_tables(dealt)
    return chosen


def nested_runs(
    df: DataFrame, path: str, group: str, kind: str, features: list[str], label: str, *, seed: int = 0, repeats: int = 5, outer: int = 5, inner: int = 5, trials: int | None = 4,
    patience_share: float | None = None, calibration: str | None = None,
) -> DataFrame:
    """(repeat, outer_fold, level, setting, thresholds, the seven metrics, mean, sd): nested cross-validation, written fold by fold.

    Each repeat deals the groups anew; in each outer fold settings are searched over inner group
    folds of the training rows, thresholds of nights and patients are chosen on the training rows,
    and the test rows are measured at both levels.  ``path`` holds a run log, a manifest and a table
    for each finished fold: a run that was killed goes on with the folds that are not finished,
    and one with other arguments at the same path is refused.
    """
    spark = df.sparkSession
    about = {
        "kind": kind, "features": features, "label": label, "group": group, "seed": seed, "repeats": repeats, "outer": outer, "inner": inner, "trials": trials,
        "patience_share": patience_share, "calibration": calibration,
    }
    told = _text_at(spark, f"{path}/manifest")
    if told is None:
        spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    elif json.loads(told) != about:
        raise ValueError(f"{path} holds a run with other arguments: {told}")
    done = {r.run for r in R.last_states(_log(spark, path)).where("status = 'finished'").collect()}  # a row for each fold
    for r, (outer_seed, inner_seeds) in enumerate(R.seed_schedule(seed, repeats, outer).items()):
        runs = [f"repeat{r}-fold{k}" for k in range(outer)]
        if set(runs) <= done:
            continue
        dealt = materialize(df.join(group_folds(df, group, label, outer, outer_seed).select(group, F.col("fold").alias("_outer")), group), "outer")
        for k, run in enumerate(runs):
            if run in done:
                continue
            R.log_run(spark, f"{path}/log", run, "begun")
            train, test = dealt.where(F.col("_outer") != k).drop("_outer"), dealt.where(F.col("_outer") == k).drop("_outer")
            chosen = search_folds(train, group, kind, features, label, inner, inner_seeds[k], trials)
            if calibration:
                model = calibrate_out_of_fold(train, group, kind, features, label, chosen, method=calibration, seed=inner_seeds[k])
                score = model.transform
            else:
                fitted = fit(train, kind, features, label, chosen, group, patience_share, inner_seeds[k])
                score = lambda d, m=fitted: L.probabilities(m, d)
            seen = score(train)
            cut = V.roc_operating_point(V.curve(seen, "prob", label)).first().threshold
            votes = V.patient_votes(seen, group, "prob", label, cut)
            patient_cut = V.roc_operating_point(V.curve(votes, "mean_prob", "ground_truth")).first().threshold
            rows = level_metrics(score(test), group, label, cut, patient_cut)
            head = [F.lit(r).alias("repeat"), F.lit(k).alias("outer_fold")]
            tail = [F.lit(json.dumps(chosen, sort_keys=True)).alias("setting"), F.lit(cut).alias("night_threshold"), F.lit(patient_cut).alias("patient_threshold")]
            rows.select(*head, "level", *tail, *V.METRICS, "mean", "sd").coalesce(1).write.mode("overwrite").parquet(f"{path}/folds/{run}")
            R.log_run(spark, f"{path}/log", run, "finished")
        remove_tables(dealt)
    return spark.read.parquet(*[f"{path}/folds/repeat{r}-fold{k}" for r in range(repeats) for k in range(outer)])


def run_summary(runs: DataFrame) -> DataFrame:
    """(level, metric, mean, sd, n) over all folds of all repeats."""
    return R.score_summary(runs, list(V.METRICS), ["level"])


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/log")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "run string, status string, at timestamp, fields string")


def _text_at(spark: SparkSession, path: str) -> str | None:
    try:
        return spark.read.text(path).first().value
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def evaluate(nights: DataFrame, path: str, key: str, night: str, prob: str, label: str, night_threshold: float, patient_threshold: float, *, resamples: int = 2000, points: int = 100) -> None:
    """Write what is known of scored nights below ``path``, as JSON tables that Spark reads back.

    ``night_scores`` and ``patient_scores`` (metrics, mean, deviation, confusion counts), ``patient_intervals``
    (bootstrap), ``curves`` (ROC and precision-recall of both levels on a grid), ``wrong_nights`` by
    patient, ``diagnostics`` (Brier score and calibration error of patients), ``nights`` and ``patients`` (predictions).
    """
    rows = nights.select(F.col(key).alias("id"), F.col(night).alias("night"), F.col(prob).cast("double").alias("prob"), F.col(label).cast("int").alias("ground_truth"))
    rows = materialize(rows, "evaluated")
    votes = materialize(V.patient_votes(rows, "id", "prob", "ground_truth", night_threshold, patient_threshold), "votes")
    people = votes.select("id", F.col("mean_prob").alias("prob"), "ground_truth")
    put = lambda df, name: df.write.mode("overwrite").json(f"{path}/{name}")
    for level, df, cut in (("night", rows, night_threshold), ("patient", people, patient_threshold)):
        counts = V.confusion(df, "prob", "ground_truth", cut).select("tp", "fp", "fn", "tn")
        put(V.metric_suite(df, "prob", "ground_truth", cut).crossJoin(F.broadcast(counts)).withColumn("threshold", F.lit(cut)), f"{level}_scores")  # one row each
    put(V.bootstrap(people, "prob", "ground_truth", resamples, patient_threshold), "patient_intervals")
    curves = None
    for level, df in (("night", rows), ("patient", people)):
        c = V.curve(df, "prob", "ground_truth")
        for kind, grid, x, y in (("roc", roc_on_grid, "fpr", "tpr"), ("pr", pr_on_grid, "recall", "precision")):
            one = grid(c, points=points).select(F.lit(level).alias("level"), F.lit(kind).alias("curve"), "i", F.col(x).alias("x"), F.col(y).alias("y"))
            curves = one if curves is None else curves.union(one)
    put(curves, "curves")
    put(V.wrong_nights(rows, "id", "prob", "ground_truth", night_threshold), "wrong_nights")
    put(V.brier_ece(people, "prob", "ground_truth"), "diagnostics")
    put(rows.withColumn("pred", (F.col("prob") >= night_threshold).cast("int")), "nights")
    put(votes, "patients")
    remove_tables(rows, votes)


def permuted(df: DataFrame, id_col: str, columns: list[str], seed: int) -> DataFrame:
    """``df`` with shadow_<column>: the columns of another row each, by a permutation drawn from hashes of the ids.

    Rows are ranked by two hashes in two levels, and the row of one rank takes the values of the
    other's: a join, no task sees all rows.  Ids are distinct.
    """
    def by_hash(salt: int, *more: str) -> DataFrame:
        hashed = df.select(F.col(id_col).alias(f"_id{salt}"), F.shiftright(F.xxhash64(F.lit(seed), F.lit(salt), F.col(id_col)), 8).alias("_h"), F.lit(1).alias("_n"), *more)
        return running_totals(hashed, [], "_h", ["_n"], descending=False).drop("_h", "_n")

    values = [F.col(c).alias(f"shadow_{c}") for c in columns]
    taken = by_hash(1).join(by_hash(2, *columns).select("cum__n", *values), "cum__n").drop("cum__n")
    return df.join(taken, df[id_col] == taken._id1).drop("_id1")


def binomial_tail(n: int, k: int) -> float:
    """Chance of ``k`` heads or more in ``n`` throws of a fair coin."""
    return sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n


def boruta(df: DataFrame, id_col: str, features: list[str], label: str, *, repeats: int = 20, alpha: float = 0.05, seed: int = 42, trees: int = 50, depth: int = 5) -> DataFrame:
    """(feature, hits, repeats, decision, importance, importance_sd, rank): features that beat the best of permuted copies of all of them.

    In each repeat a forest is fitted on the features and their shadows, whose rows are permuted
    together; a hit is an importance above every shadow's.  A feature is accepted (rejected) if so
    many (few) hits would be a chance of under ``alpha``, divided by the number of features, for a
    fair coin, else tentative.  Ranks are by mean importance, ties at the highest rank.  Rows need
    distinct ids and no nulls in features; the result depends on the seed and the rows alone.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col), *features, F.col(label).cast("double").alias(label))
    hits, seen = dict.fromkeys(features, 0), {f: [] for f in features}
    names = [*features, *(f"shadow_{f}" for f in features)]
    for r in range(repeats):
        both = materialize(permuted(rows, id_col, features, seed + r).select(id_col, label, *names), "shadows")
        # A forest's samples depend on the rows' places: by the ids' hashes, as files are read back by size and ranges are sampled.
        placed = both.repartition(8, id_col).sortWithinPartitions(id_col)
        model = L.pipeline("rf", names, label, numTrees=trees, maxDepth=depth, seed=seed + r).fit(placed)
        remove_tables(both)
        weights = dict(zip(names, model.stages[-1].featureImportances.toArray().tolist(), strict=True))
        best = max(weights[f"shadow_{f}"] for f in features)
        for f in features:
            hits[f] += weights[f] > best
            seen[f].append(weights[f])
    level = alpha / len(features)

    def decision(k: int) -> str:
        if binomial_tail(repeats, k) < level:
            return "accepted"
        return "rejected" if binomial_tail(repeats, repeats - k) < level else "tentative"

    mean = {f: sum(v) / repeats for f, v in seen.items()}
    sd = {f: math.sqrt(sum((x - mean[f]) ** 2 for x in v) / repeats) for f, v in seen.items()}
    table = [(f, hits[f], repeats, decision(hits[f]), mean[f], sd[f]) for f in features]
    found = spark.createDataFrame(table, "feature string, hits int, repeats int, decision string, importance double, importance_sd double")
    return ranked(found, -F.col("importance"))
