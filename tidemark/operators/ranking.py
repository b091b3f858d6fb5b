"""Scalers and feature ranking.  Feature lists are short; rows are many and only ever aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import correlation

from .evaluation import dealt, running_totals
from .quantiles import quantile_columns
from .windows import rank_max

SCALE_FLOOR = 1e-8


def scale_parameters(df: DataFrame, features: list[str], method: str, keys: list[str] = ()) -> DataFrame:
    """A row for each key: <feature>_c (centre) and <feature>_s (scale, 1 for none) of standard, minmax or robust scaling.

    Robust scaling takes exact quantiles, see :mod:`.quantiles`.
    """
    if method == "robust":
        wanted = {f"{f}_{int(100 * q)}": (f, q) for f in features for q in (0.25, 0.5, 0.75)}
        found = quantile_columns(df, wanted, list(keys))
        forms = [(f, F.col(f"{f}_50"), F.col(f"{f}_75") - F.col(f"{f}_25")) for f in features]
        return found.select(*keys, *[c for f, centre, s in forms for c in (centre.alias(f"{f}_c"), F.when(s > SCALE_FLOOR, s).otherwise(F.lit(1.0)).alias(f"{f}_s"))])
    forms = {"standard": lambda f: (F.avg(f), F.stddev_pop(f)), "minmax": lambda f: (F.min(f), F.max(f) - F.min(f))}
    out = []
    for f in features:
        c, s = forms[method](f)
        out += [c.alias(f"{f}_c"), F.when(s > SCALE_FLOOR, s).otherwise(F.lit(1.0)).alias(f"{f}_s")]
    return df.groupBy(*keys).agg(*out)


def apply_scale(df: DataFrame, parameters: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """Scaled features; with keys, rows of a key without parameters get the mean of all keys' (macro average).

    Keys are few (data sets): their parameters go to the rows, which are not dealt by key.
    """
    if not keys:
        joined = df.crossJoin(F.broadcast(parameters))  # one row
        value = lambda f, p: F.col(f"{f}_{p}")
    else:
        names = [f"{f}_{p}" for f in features for p in "cs"]
        macro = parameters.agg(*[F.avg(n).alias(f"_m_{n}") for n in names])
        joined = df.join(F.broadcast(parameters), keys, "left").crossJoin(F.broadcast(macro))  # one row
        value = lambda f, p: F.coalesce(F.col(f"{f}_{p}"), F.col(f"_m_{f}_{p}"))
    keep = [c for c in df.columns if c not in features]
    return joined.select(*keep, *[((F.col(f) - value(f, "c")) / value(f, "s")).alias(f) for f in features])


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, rank, n): ranks from 1 by ascending value, ties at their mean; a row for each distinct value."""
    counts = dealt(df, value).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(counts, [], "value", ["n"], descending=False)
    return cum.select("value", (F.col("cum_n") - (F.col("n") - 1) / 2).alias("rank"), "n")


def long_features(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """(keep, feature, value) rows."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select(
        *keep, "x.feature", "x.value"
    )


def label_correlations(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, pearson, spearman, kendall) with a 0/1 label.

    Spearman is Pearson's of mean ranks; Kendall's tau-b follows from how many rows of each label
    lie below each distinct value: running totals, not pairs.
    """
    rows = long_features(dealt(df, *dict.fromkeys([*features, label])), features, label).withColumn("y", F.col(label).cast("long"))
    counts = rows.groupBy("feature", "value").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("neg", F.col("n") - F.col("pos"))
    cum = running_totals(counts, ["feature"], "value", ["n", "neg", "pos"], descending=False)
    rank = F.col("cum_n") - (F.col("n") - 1) / 2
    below_n, below_p = F.col("cum_neg") - F.col("neg"), F.col("cum_pos") - F.col("pos")
    d = lambda c: c.cast("double")
    s = cum.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(d(F.col("n")) * F.col("value")).alias("sx"), F.sum(d(F.col("n")) * F.col("value") * F.col("value")).alias("sxx"),
        F.sum(d(F.col("pos")) * F.col("value")).alias("sxy"), F.sum(d(F.col("n")) * rank).alias("sr"), F.sum(d(F.col("n")) * rank * rank).alias("srr"), F.sum(d(F.col("pos")) * rank).alias("sry"),
        F.sum(d(F.col("pos")) * below_n - d(F.col("neg")) * below_p).alias("con"), F.sum(d(F.col("n")) * (F.col("n") - 1) / 2).alias("ties"),
    )
    n, p = d(F.col("n")), d(F.col("p"))
    vy = p / n - p / n * (p / n)

    def corr(sx: str, sxx: str, sxy: str) -> Column:
        vx = F.col(sxx) / n - F.pow(F.col(sx) / n, 2)
        return F.when((vx > 0) & (vy > 0), (F.col(sxy) / n - F.col(sx) / n * (p / n)) / F.sqrt(vx * vy))

    pairs = n * (n - 1) / 2
    ty = p * (p - 1) / 2 + (n - p) * (n - p - 1) / 2
    tau = F.when((pairs > F.col("ties")) & (pairs > ty), F.col("con") / F.sqrt((pairs - F.col("ties")) * (pairs - ty)))
    return s.select("feature", corr("sx", "sxx", "sxy").alias("pearson"), corr("sr", "srr", "sry").alias("spearman"), tau.alias("kendall"))


def redundancy(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, redundancy): mean absolute correlation with the other features; one aggregate over all rows."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    one = df.agg(*[F.abs(correlation(a, b)).alias(f"{a}|{b}") for a, b in pairs])
    each = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(f"`{a}|{b}`").alias("v")) for a, b in pairs for x in (a, b)])
    return one.select(F.explode(each).alias("e")).groupBy(F.col("e.feature").alias("feature")).agg(F.avg("e.v").alias("redundancy"))


def scaled_variance(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, variance, median) after min-max scaling; a feature without spread has variance 0."""
    middle = quantile_columns(df, {f"_m{i}": (f, 0.5) for i, f in enumerate(features)})
    cells, sums = [], []
    for i, f in enumerate(features):
        sums += [F.min(f).alias(f"_l{i}"), (F.max(f) - F.min(f)).alias(f"_s{i}"), F.var_pop(f).alias(f"_v{i}")]
        low, span, wide = F.col(f"_l{i}"), F.col(f"_s{i}"), F.col(f"_s{i}") > 0
        cells.append(F.struct(F.lit(f).alias("feature"), F.when(wide, F.col(f"_v{i}") / (span * span)).otherwise(F.lit(0.0)).alias("variance"),
                              F.when(wide, (F.col(f"_m{i}") - low) / span).otherwise(F.lit(0.0)).alias("median")))
    return df.agg(*sums).crossJoin(F.broadcast(middle)).select(F.explode(F.array(*cells)).alias("x")).select("x.*")  # one row each


def ranked(scores: DataFrame, value: Column, name: str = "rank") -> DataFrame:
    """Feature scores with ranks by ascending ``value``, ties at the highest."""
    return scores.withColumn("_v", value).withColumn(name, rank_max([], F.col("_v"))).drop("_v")


def fuse(ranks: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(feature, fused, rank) of (feature, method, rank) rows: weighted mean over the methods that rank the feature, ranked again."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("method")]
    mean = ranks.where("rank is not null").groupBy("feature").agg((F.sum(w * F.col("rank")) / F.sum(w)).alias("fused"))
    return ranked(mean, F.round("fused", 9))


def borda(ranks: DataFrame) -> DataFrame:
    """(feature, points, rank): each method gives as many points as it ranks features behind."""
    n = F.count(F.lit(1)).over(Window.partitionBy("method"))
    points = ranks.withColumn("b", n - F.col("rank")).groupBy("feature").agg(F.sum("b").alias("points"))
    return ranked(points, -F.col("points"))


def top_features(ranks: DataFrame, k: int) -> DataFrame:
    return ranks.where(F.col("rank") <= k)


def welch_t(df: DataFrame, value: str, group: str, a, b, keys: list[str] = ()) -> DataFrame:
    """(keys, t, dof) of two groups with unequal variances."""
    of = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    s = df.groupBy(*keys).agg(*[of(g, f).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    e0, e1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    return s.select(*keys, ((F.col("m0") - F.col("m1")) / F.sqrt(e0 + e1)).alias("t"), (F.pow(e0 + e1, 2) / (e0 * e0 / (F.col("n0") - 1) + e1 * e1 / (F.col("n1") - 1))).alias("dof"))


def mann_whitney_u(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """(u, n0, n1) of group ``a`` against ``b``: rank sum less its least value, ties at half."""
    rows = df.where(F.col(group).isin(a, b)).withColumn("pos", (F.col(group) == a).cast("long"))
    counts = dealt(rows, value, "pos").groupBy(F.col(value).alias("value")).agg(F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    cum = running_totals(counts, [], "value", ["n"], descending=False)
    rank = F.col("cum_n") - (F.col("n") - 1) / 2
    s = cum.agg(F.sum(F.col("pos") * rank).alias("r"), F.sum("pos").alias("n0"), F.sum(F.col("n") - F.col("pos")).alias("n1"))
    return s.select((F.col("r") - F.col("n0") * (F.col("n0") + 1) / 2).alias("u"), "n0", "n1")


def f_statistics(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, f): one-way analysis of variance between the label's classes."""
    rows = long_features(df, features, label)
    g = rows.groupBy("feature", label).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = g.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    j = g.join(t, "feature").groupBy("feature").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.max("total").alias("n"), F.max("k").alias("k")
    )
    return j.select("feature", F.when(F.col("within") > 0, (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"))


def mrmr(df: DataFrame, features: list[str], label: str, k: int) -> list[str]:
    """The first ``k`` features by relevance over redundancy: F statistics and correlations from two aggregates, the greedy choice on the driver over features alone."""
    relevance = {r.feature: r.f or 0.0 for r in f_statistics(df, features, label).collect()}
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(*[F.abs(correlation(a, b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    corr = {}
    for i, (a, b) in enumerate(pairs):
        corr[a, b] = corr[b, a] = row[i] or 0.0
    chosen: list[str] = []
    while len(chosen) < min(k, len(features)):
        gain = lambda f: relevance[f] / max(sum(corr[f, c] for c in chosen) / len(chosen), 1e-3) if chosen else relevance[f]
        chosen.append(max((f for f in features if f not in chosen), key=gain))
    return chosen
