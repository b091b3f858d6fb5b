"""Curves, operating points, metrics, calibration and votes, from (score, label) rows.

Curves need running totals over all distinct scores.  They are built in two levels, inside score
ranges and over the ranges' sums, so no task sorts all rows; rows of equal score are summed first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import correlation
from tidemark.functions.shared import materialize

RANGES = 256


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, dealt to all shuffle partitions by their hash before values are counted.

    Counting keeps a task's distinct values in memory, and a file's split may hold millions of rows; the
    partitions' number is given, so that adaptive execution doesn't join them again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*columns).repartition(n, *columns)


def running_totals(df: DataFrame, keys: list[str], order: str, columns: list[str], descending: bool = True, ranges: int = RANGES) -> DataFrame:
    """``df`` (a row for each key and value of ``order``) with cum_<column>: the totals up to and with the row."""
    ends = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi")) if keys else df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    joined = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # one row
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col(order) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    rows = joined.withColumn("_r", F.least(F.floor(share * ranges), F.lit(ranges - 1))).drop("_lo", "_hi")
    way = F.desc if descending else F.asc
    sums = rows.groupBy(*keys, "_r").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy(way("_r")).rowsBetween(Window.unboundedPreceding, -1)
    # At most ``ranges`` rows for each key.
    offsets = sums.select(*keys, "_r", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_r").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select("*", *[F.sum(c).over(inside).alias(f"_c_{c}") for c in columns]).join(offsets, [*keys, "_r"])
    return out.select(*df.columns, *[(F.col(f"_c_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in columns])


def curve(df: DataFrame, score: str, label: str, keys: list[str] = ()) -> DataFrame:
    """(keys, score, pos, neg, tp, fp, p, n): for each distinct score as threshold (>=), true and false positives, with the totals."""
    keys = list(keys)
    counts = dealt(df, *dict.fromkeys([*keys, score, label])).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )
    cum = running_totals(counts, keys, "score", ["pos", "neg"]).withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return cum.join(totals, keys) if keys else cum.crossJoin(F.broadcast(totals))  # one row


def roc_auc(c: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at half."""
    below = F.col("n") - F.col("fp")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return c.groupBy(*keys).agg((wins / (F.max("p") * F.max("n"))).alias("roc_auc"))


def average_precision(c: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Precision at each threshold, weighted by the recall gained there."""
    return c.groupBy(*keys).agg(F.sum(F.col("pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def roc_operating_point(c: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The threshold nearest to (0, 1); of equal ones the highest; where rejecting all is nearest, 0.5."""
    d = F.sqrt(F.pow(F.col("fp") / F.col("n"), 2) + F.pow(1 - F.col("tp") / F.col("p"), 2))
    best = c.groupBy(*keys).agg(F.min(F.struct(d.alias("d"), (-F.col("score")).alias("t"))).alias("b"))
    near = F.col("b.d") < 1
    return best.select(*keys, F.when(near, -F.col("b.t")).otherwise(F.lit(0.5)).alias("threshold"), F.least("b.d", F.lit(1.0)).alias("distance"))


def pr_operating_points(c: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The thresholds nearest to (recall, precision) = (1, 1) and of the highest F1; of equal ones the highest."""
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("p")
    d = F.sqrt(F.pow(1 - precision, 2) + F.pow(1 - recall, 2))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))
    best = c.groupBy(*keys).agg(
        F.min(F.struct(F.round(d, 12).alias("d"), (-F.col("score")).alias("t"))).alias("near"), F.max(F.struct(F.round(f1, 12).alias("f1"), F.col("score").alias("t"))).alias("f")
    )
    return best.select(*keys, (-F.col("near.t")).alias("dist_threshold"), F.col("f.t").alias("f1_threshold"), F.col("f.f1").alias("f1"))


def macro_balanced_accuracy(df: DataFrame, score: str, label: str, group: str, grid: int = 401, weighted: bool = False) -> DataFrame:
    """(threshold, macro_ba) of all candidates: an even grid of 0 .. 1 and the distinct scores; mean over groups of balanced accuracy.

    Groups with one class don't count; ``weighted`` weights a group by the square of its rows (each of its
    rows weighs as much as the group has rows, as users of these names expect).  Candidates and rows are put
    in one running total for each group, never every candidate against every row.
    """
    rows = df.select(F.col(group).alias("g"), F.col(score).cast("double").alias("score"), F.col(label).alias("y"))
    both = rows.groupBy("g").agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.sum((F.col("y") == 0).cast("long")).alias("n")).where("p > 0 and n > 0")
    steps = df.sparkSession.range(grid).select((F.col("id") / (grid - 1)).alias("score"))
    candidates = steps.union(rows.select("score")).distinct()
    at = candidates.crossJoin(F.broadcast(both.select("g")))  # groups are data sets: few
    points = rows.groupBy("g", "score").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))
    full = at.join(points, ["g", "score"], "left").fillna(0, ["pos", "neg"])
    cum = running_totals(full, ["g"], "score", ["pos", "neg"]).join(both, "g")
    ba = (F.col("cum_pos") / F.col("p") + 1 - F.col("cum_neg") / F.col("n")) / 2
    size = F.col("p") + F.col("n")
    weight = size * size if weighted else F.lit(1)
    return cum.groupBy(F.col("score").alias("threshold")).agg((F.sum(ba * weight) / F.sum(weight)).alias("macro_ba"))


def macro_threshold(candidates: DataFrame) -> DataFrame:
    """The best candidate; of equal ones the lowest."""
    best = candidates.agg(F.max(F.struct(F.round("macro_ba", 9).alias("b"), (-F.col("threshold")).alias("t"))).alias("x"))
    return best.select((-F.col("x.t")).alias("threshold"), F.col("x.b").alias("macro_ba"))


def safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5, keys: list[str] = ()) -> DataFrame:
    """Confusion counts and the metrics that follow from them; undefined ratios are 0."""
    hit = F.col(score) >= threshold
    n = lambda pred, y: F.sum(((hit == F.lit(pred)) & (F.col(label) == y)).cast("long"))
    c = df.groupBy(*keys).agg(n(True, 1).alias("tp"), n(True, 0).alias("fp"), n(False, 1).alias("fn"), n(False, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    sens, spec, prec = safe(tp, tp + fn), safe(tn, tn + fp), safe(tp, tp + fp)
    return c.select(
        *keys, "tp", "fp", "fn", "tn", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), prec.alias("precision"), sens.alias("recall"), spec.alias("specificity"),
        safe(tn, tn + fn).alias("npv"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), ((sens + spec) / 2).alias("balanced_accuracy"),
    )


def brier_ece(df: DataFrame, prob: str, label: str, bins: int | None = None) -> DataFrame:
    """Brier score and expected calibration error over clip(sqrt(n), 5, 20) right-closed bins."""
    if bins is None:
        bins = int(min(max(math.sqrt(df.count()), 5), 20))
    p, y = F.col(prob).cast("double"), F.col(label).cast("double")
    binned = df.groupBy(F.least(F.greatest(F.ceil(p * bins), F.lit(1)), F.lit(bins)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((p - y) * (p - y)).alias("sq")
    )
    # The bins' sums: ``bins`` rows.
    return binned.agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def calibration_curve(df: DataFrame, prob: str, label: str, bins: int | None = None) -> DataFrame:
    """(bin, n, mean_prob, share): quantile bins by Sturges' rule; equal edges merge."""
    if bins is None:
        bins = math.ceil(math.log2(max(df.count(), 1))) + 1
    from .quantiles import exact_quantiles

    found = exact_quantiles(df, {"p": prob}, [i / bins for i in range(1, bins)]) if bins > 1 else df.sparkSession.createDataFrame([], "value double")
    edges = found.agg(F.sort_array(F.collect_list("value")).alias("_e"))  # an edge a bin
    placed = df.crossJoin(F.broadcast(edges))  # one row
    at = F.size(F.filter("_e", lambda e: e < F.col(prob))).alias("bin")
    return placed.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(label).cast("double")).alias("share"))


def patient_votes(df: DataFrame, key: str, prob: str, label: str, night_threshold: float = 0.5, patient_threshold: float = 0.5) -> DataFrame:
    """Votes of a patient's nights: mean probability (strict), majority (half counts), either, both; ``labels`` over 1 marks a conflict."""
    pred = (F.col(prob) >= night_threshold).cast("long")
    g = df.groupBy(key).agg(
        F.avg(prob).alias("mean_prob"), F.sum(prob).alias("sum_prob"), F.max(prob).alias("max_prob"), F.avg(pred).alias("mean_pred"), F.sum(pred).alias("sum_pred"),
        F.count(F.lit(1)).alias("n_nights"), F.countDistinct(label).alias("labels"), F.max(label).alias("ground_truth"),
    )
    mean_vote, majority = F.col("mean_prob") > patient_threshold, F.col("sum_pred") >= F.col("n_nights") / 2
    return g.select("*", mean_vote.alias("mean_vote"), majority.alias("majority"), (mean_vote | majority).alias("ensemble_any"), (mean_vote & majority).alias("ensemble_all"))


def wrong_nights(df: DataFrame, key: str, prob: str, label: str, threshold: float = 0.5) -> DataFrame:
    wrong = ((F.col(prob) >= threshold).cast("int") != F.col(label)).cast("long")
    return df.groupBy(key).agg(F.sum(wrong).alias("wrong")).where("wrong > 0")


#: The seven metrics, in order.
METRICS = ("accuracy", "precision", "recall", "f1", "average_precision", "roc_auc", "balanced_accuracy")


def metric_suite(df: DataFrame, score: str, label: str, threshold: float = 0.5, keys: list[str] = ()) -> DataFrame:
    """(keys, the seven METRICS, mean, sd): one row a key, with the mean and population deviation of the seven.

    Rows without a score or label take no part; undefined ratios are 0, and areas are null where a
    class is absent (then mean and sd are null too).
    """
    keys = list(keys)
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = confusion(rows, score, label, threshold, keys)
    c = curve(rows, score, label, keys).withColumnsRenamed({"pos": "_pos", "neg": "_neg"})
    wins = F.sum(F.col("_pos") * (F.col("n") - F.col("fp") + F.col("_neg") / 2))
    both = (F.max("p") > 0) & (F.max("n") > 0)
    gained = F.sum(F.when(F.col("p") > 0, F.col("_pos") / F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))))
    areas = c.groupBy(*keys).agg(F.when(both, wins / (F.max("p") * F.max("n"))).alias("roc_auc"), F.when(both, gained).alias("average_precision"))
    joined = counts.join(areas, keys) if keys else counts.crossJoin(F.broadcast(areas))  # one row
    values = [F.col(m) for m in METRICS]
    mean = sum(values[1:], values[0]) / len(values)
    spread = F.sqrt(sum(((v - mean) * (v - mean) for v in values[1:]), (values[0] - mean) * (values[0] - mean)) / len(values))
    return joined.select(*keys, *METRICS, mean.alias("mean"), spread.alias("sd"))


#: Resampled counts that a task holds at a time.
RESAMPLED = 1 << 21


def _draw(rng: np.random.Generator, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each of ``n`` a multinomial draw of so many over the weights; all zero where the weights are."""
    total = weights.sum()
    if not total:
        return np.zeros((len(n), len(weights)), np.int64)
    return rng.multinomial(n, weights / total)


def bootstrap(df: DataFrame, score: str, label: str, resamples: int = 2000, threshold: float = 0.5, seed: int = 42, ranges: int = RANGES) -> DataFrame:
    """(metric, point, mean, sd, margin, lower, upper) of the seven METRICS over resamples that keep the size of each class.

    Resampling rows is drawing counts of the distinct (score, label) cells: first how many rows of each
    class fall into each range of scores, then inside each range how many have each score.  A
    range's task draws the ranges' counts of all resamples from the same seed, so it knows what lies
    above it; its part of each curve is summed with the others'.  Draws depend on the seed and the
    distinct scores alone, not on partitioning.  The interval is Student's t of the resamples' mean
    at 95 %.  Rows without a score or label take no part; with one class there is no row.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1))
    counts = rows.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )
    counts = materialize(counts, "scores")
    # Ranges of nearly equal numbers of distinct scores, however they are spread.
    cuts = counts.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("c")).first().c or []
    cuts = np.unique(np.array(cuts, dtype=float))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(range=np.searchsorted(cuts, pdf["score"].to_numpy(), side="left").astype(np.int32))

    placed = counts.mapInPandas(place, "score double, pos long, neg long, range int")
    sums = placed.groupBy("range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).orderBy(F.desc("range")).toPandas()  # a row a range
    p, n = int(sums["pos"].sum()), int(sums["neg"].sum())
    schema = "b int, tp long, fp long, auc double, ap double"
    names = "metric string, point double, mean double, sd double, margin double, lower double, upper double"
    if not p or not n:
        return df.sparkSession.createDataFrame([], names)
    order = {r: i for i, r in enumerate(sums["range"].tolist())}

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", ascending=False)
        at = order[int(pdf["range"].iloc[0])]
        top = np.random.default_rng([seed, 0])
        pos_of = _draw(top, np.full(resamples, p), sums["pos"].to_numpy(float))
        neg_of = _draw(top, np.full(resamples, n), sums["neg"].to_numpy(float))
        above_pos, above_neg = pos_of[:, :at].sum(1), neg_of[:, :at].sum(1)
        hit = pdf["score"].to_numpy() >= threshold
        rng, out = np.random.default_rng([seed, 1, at]), []
        step = max(1, RESAMPLED // len(pdf))
        for lo in range(0, resamples, step):
            b = slice(lo, min(lo + step, resamples))
            pos = _draw(rng, pos_of[b, at], pdf["pos"].to_numpy(float))
            neg = _draw(rng, neg_of[b, at], pdf["neg"].to_numpy(float))
            tp, fp = pos.cumsum(1) + above_pos[b, None], neg.cumsum(1) + above_neg[b, None]
            auc = (pos * (n - fp + neg / 2)).sum(1) / (p * n)
            ap = (pos / p * (tp / np.maximum(tp + fp, 1))).sum(1)
            out.append(pd.DataFrame({"b": np.arange(b.start, b.stop, dtype=np.int32), "tp": pos[:, hit].sum(1), "fp": neg[:, hit].sum(1), "auc": auc, "ap": ap}))
        return pd.concat(out)

    each = placed.groupBy("range").applyInPandas(part, schema).groupBy("b").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "auc", "ap")])
    tp, fp = F.col("tp"), F.col("fp")
    recall, precision, rejected = tp / p, safe(tp, tp + fp), 1 - fp / n
    formulas = {
        "accuracy": (tp + n - fp) / (p + n), "precision": precision, "recall": recall, "f1": safe(2 * tp, tp + fp + p), "average_precision": F.col("ap"), "roc_auc": F.col("auc"),
        "balanced_accuracy": (recall + rejected) / 2,
    }
    long = each.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), formulas[m].cast("double").alias("v")) for m in METRICS])).alias("x")).select("x.*")
    margin = t_quantiles(F.count("v") - 1) * F.stddev_samp("v") / F.sqrt(F.count("v"))
    found = long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), margin.alias("margin"))
    points = metric_suite(rows, score, label, threshold)
    points = points.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("point")) for m in METRICS])).alias("x")).select("x.*")
    return found.join(points, "metric").select("metric", "point", "mean", "sd", "margin", (F.col("mean") - F.col("margin")).alias("lower"), (F.col("mean") + F.col("margin")).alias("upper"))


def _t_tail(t: float, freedom: int) -> float:
    """Chance that Student's t with so many degrees of freedom lies over ``t`` > 0, by its finite series."""
    angle = math.atan(t / math.sqrt(freedom))
    c = math.cos(angle)
    term, total = (1.0, 0.0) if freedom % 2 == 0 else (c, 0.0)
    for k in range(2 if freedom % 2 == 0 else 3, freedom + 1, 2):
        total += term
        term *= c * c * (k - 1) / k
    inside = math.sin(angle) * total if freedom % 2 == 0 else 2 / math.pi * (angle + math.sin(angle) * total)
    return (1 - inside) / 2


def t_quantile(freedom: int, tail: float = 0.025) -> float:
    """The value that Student's t passes with chance ``tail``, by bisection."""
    low, high = 0.0, 1.0
    while _t_tail(high, freedom) > tail:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _t_tail(middle, freedom) > tail else (low, middle)
    return high


#: Degrees of freedom up to which quantiles are taken from exact values; beyond, five terms of the series in 1 / freedom agree to 1e-5.
EXACT_T = 15


def t_quantiles(freedom: Column, z: float = 1.959963984540054) -> Column:
    """Two-sided 95 % quantile of Student's t; null without a degree of freedom."""
    terms = [
        z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    far = sum((F.lit(t) / F.pow(freedom.cast("double"), F.lit(k)) for k, t in enumerate(terms)), F.lit(0.0))
    near = F.element_at(F.array(*[F.lit(t_quantile(k)) for k in range(1, EXACT_T + 1)]), F.greatest(F.least(freedom, F.lit(EXACT_T)), F.lit(1)).cast("int"))
    return F.when(freedom > EXACT_T, far).when(freedom >= 1, near)


def mean_ci(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Mean, deviation and 95 % interval by Student's t with n - 1 degrees of freedom; bounds are null for a single value."""
    half = t_quantiles(F.count(value) - 1) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.avg(value) - half).alias("lower"), (F.avg(value) + half).alias("upper"))


def pearson_ci(df: DataFrame, x: str, y: str, keys: list[str] = (), quantile: float = 1.959963984540054) -> DataFrame:
    """Correlation with its interval by Fisher's z."""
    c = df.groupBy(*keys).agg(correlation(x, y).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 3")
    half = F.lit(quantile) / F.sqrt(F.col("n") - 3)
    return c.select(*keys, "r", F.tanh(F.atanh("r") - half).alias("lower"), F.tanh(F.atanh("r") + half).alias("upper"))
