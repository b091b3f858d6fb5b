"""Decision thresholds chosen by name, for nights and patients, and curves on an even grid.

Rows without a score or label take no part; empty tables and tables of one class have no curve, so
a threshold that needs one is null; repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.shared import materialize

from . import evaluation as V

BASE = ("roc_dist", "pr_dist", "pr_f1")


def fixed_threshold(name: str) -> float | None:
    """The number that a name such as ``0.42``, ``fixed:0.42`` or ``fixed_0.42`` stands for, else None."""
    text = name.strip().lower()
    for prefix in ("fixed:", "fixed_"):
        text = text.removeprefix(prefix)
    try:
        return float(text)
    except ValueError:
        return None


def base_threshold(c: DataFrame, method: str, keys: list[str] = ()) -> DataFrame:
    """(keys, threshold) of curves: nearest to the ROC or precision-recall corner, or of the highest F1."""
    if method == "roc_dist":
        return V.roc_operating_point(c, keys).select(*keys, "threshold")
    points = V.pr_operating_points(c, keys)
    return points.select(*keys, F.col("dist_threshold" if method == "pr_dist" else "f1_threshold").alias("threshold"))


def choose_threshold(df: DataFrame, score: str, label: str, name: str, dataset: str | None = None) -> DataFrame:
    """One row (threshold), by name: ``default``, a fixed number, one of ``BASE``, ``macro_ba``, ``macro_ba_weighted``,
    or ``<base>_per_dataset_mean`` and ``_median`` over the data sets with both classes."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    value = 0.5 if name == "default" else fixed_threshold(name)
    if value is not None:
        return df.sparkSession.range(1).select(F.lit(value).alias("threshold"))
    if name in BASE:
        one = V.curve(rows, score, label).where("p > 0 and n > 0").withColumn("all", F.lit(1))
        return base_threshold(one, name, ["all"]).agg(F.max("threshold").alias("threshold"))  # one row or none
    if name in ("macro_ba", "macro_ba_weighted"):
        return V.macro_threshold(V.macro_balanced_accuracy(rows, score, label, dataset, weighted=name.endswith("weighted"))).select("threshold")
    method, _, combine = name.partition("_per_dataset_")
    if method not in BASE or combine not in ("mean", "median"):
        raise ValueError(f"unknown threshold {name}")
    each = base_threshold(V.curve(rows, score, label, [dataset]).where("p > 0 and n > 0"), method, [dataset])
    return each.agg((F.avg("threshold") if combine == "mean" else F.median("threshold")).alias("threshold"))  # a row for each data set


def _levels(nights: DataFrame, key: str, score: str, label: str, dataset: str) -> dict[str, DataFrame]:
    """(score, label, dataset) rows of nights and of patients, whose score is the mean of their nights'."""
    votes = V.patient_votes(nights, key, score, label).select(key, F.col("mean_prob").alias(score), F.col("ground_truth").alias(label))
    patients = votes.join(nights.groupBy(key).agg(F.min(dataset).alias(dataset)), key)
    return {"night": nights.select(score, label, dataset), "patient": patients.select(score, label, dataset)}


def night_and_patient_thresholds(nights: DataFrame, key: str, score: str, label: str, name: str, dataset: str) -> DataFrame:
    """(level, name, threshold) of nights and of patients, whose score is the mean of their nights'."""
    out = [choose_threshold(d, score, label, name, dataset).select(F.lit(f).alias("level"), F.lit(name).alias("name"), "threshold") for f, d in _levels(nights, key, score, label, dataset).items()]
    return out[0].union(out[1])


#: All names beside fixed numbers.
NAMES = ("default", *BASE, "macro_ba", "macro_ba_weighted", *(f"{b}_per_dataset_{c}" for b in BASE for c in ("mean", "median")))


def threshold_menu(nights: DataFrame, key: str, score: str, label: str, dataset: str, names: list[str] = NAMES) -> DataFrame:
    """(level, name, threshold) of many names at once: each level's curves, over all and by data set, are made and written once."""
    out = None
    for level, df in _levels(nights, key, score, label, dataset).items():
        rows = materialize(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), f"{level}-rows")
        points = {}
        for of, keys in (("all", []), ("set", [dataset])):
            c = materialize(V.curve(rows, score, label, keys).where("p > 0 and n > 0").withColumn("_one", F.lit(1)), f"{level}-{of}")
            by = [*keys, "_one"]
            pr = V.pr_operating_points(c, by).select(*by, F.col("dist_threshold").alias("pr_dist"), F.col("f1_threshold").alias("pr_f1"))
            found = V.roc_operating_point(c, by).select(*by, F.col("threshold").alias("roc_dist")).join(pr, by)
            points[of] = materialize(found, f"{level}-{of}-points")  # a row, or a row a data set
        for name in names:
            method, _, combine = name.partition("_per_dataset_")
            if name in BASE:
                one = points["all"].agg(F.max(name).alias("threshold"))
            elif method in BASE and combine in ("mean", "median"):
                one = points["set"].agg((F.avg(method) if combine == "mean" else F.median(method)).alias("threshold"))
            else:
                one = choose_threshold(rows, score, label, name, dataset)
            one = one.select(F.lit(level).alias("level"), F.lit(name).alias("name"), "threshold")
            out = one if out is None else out.union(one)
    return out


def _on_grid(c: DataFrame, keys: list[str], x: str, y: str, total: str, points: int, value) -> DataFrame:
    """(keys, i, at): ``value`` of the curve's points, linear between them at i / (points - 1) of ``total`` along ``x``.

    Points fall into grid cells and only the first and the last of a cell count: ``points`` rows for each key.
    """
    start = c.groupBy(*keys).agg(F.max("p").alias("p"), F.max("n").alias("n")).select(*keys, F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "p", "n")
    rows = c.select(*keys, F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), "p", "n").union(start).where("p > 0 and n > 0")
    # The first grid point at or after x, in whole numbers.
    cell = F.expr(f"(x * {points - 1} + {total} - 1) div {total}").cast("int")
    ends = rows.groupBy(*keys, cell.alias("i"), "p", "n").agg(F.max(F.struct("x", "y")).alias("last"), F.min(F.struct("x", "y")).alias("first"))
    grid = rows.select(*keys, "p", "n").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    w = Window.partitionBy(*keys).orderBy("i") if keys else Window.orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    full = grid.join(ends, [*keys, "i", "p", "n"], "left").select("*", F.max("last").over(upto).alias("a"), F.min("first").over(after).alias("b"))
    share = (F.col("i") * F.col(total) / (points - 1) - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))
    left, right = value(F.col("a.x"), F.col("a.y")), value(F.col("b.x"), F.col("b.y"))
    return full.select(*keys, "i", "p", "n", F.when(F.col("b").isNull(), left).otherwise(left + (right - left) * share).alias("at"))


def roc_on_grid(c: DataFrame, keys: list[str] = (), points: int = 100) -> DataFrame:
    """(keys, i, fpr, tpr): the ROC curve at even false positive rates; it starts at 0."""
    g = _on_grid(c, list(keys), "fp", "tp", "n", points, lambda x, y: y / F.col("p"))
    return g.select(*keys, "i", (F.col("i") / (points - 1)).alias("fpr"), F.when(F.col("i") == 0, F.lit(0.0)).otherwise(F.col("at")).alias("tpr"))


def pr_on_grid(c: DataFrame, keys: list[str] = (), points: int = 100) -> DataFrame:
    """(keys, i, recall, precision): precision at even recalls; it starts at 1 and ends at the share of positives."""
    g = _on_grid(c, list(keys), "tp", "fp", "p", points, lambda x, y: F.when(x + y > 0, x / (x + y)).otherwise(F.lit(1.0)))
    at = F.when(F.col("i") == 0, F.lit(1.0)).when(F.col("i") == points - 1, F.col("p") / (F.col("p") + F.col("n"))).otherwise(F.col("at"))
    return g.select(*keys, "i", (F.col("i") / (points - 1)).alias("recall"), at.alias("precision"))


def grid_summary(roc: DataFrame, pr: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, auc, f1_max) of curves on a grid: trapezoids, and the highest F1."""
    k = list(keys)
    w = Window.partitionBy(*k).orderBy("i") if k else Window.orderBy("i")  # a row for each grid point
    area: Column = (F.col("tpr") + F.lag("tpr").over(w)) / 2 * (F.col("fpr") - F.lag("fpr").over(w))
    auc = roc.withColumn("area", area).groupBy(*k).agg(F.sum("area").alias("auc"))
    sums = F.col("recall") + F.col("precision")
    f1 = pr.groupBy(*k).agg(F.max(F.when(sums > 0, 2 * F.col("recall") * F.col("precision") / sums)).alias("f1_max"))
    return auc.join(f1, k) if k else auc.crossJoin(F.broadcast(f1))  # one row each
