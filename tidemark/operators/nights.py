"""Aggregates of bouts by night: eight statistics of a feature, gaps between bouts, density, clustering and efficiency."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import HOUR, SECOND, iqr, kurtosis_population, kurtosis_sample, quantile, skew_population, skew_sample
from tidemark.functions.dsp import find_peaks


def eight_statistics(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """mean, std, skew, kurt (sample forms), mad, iqr, 10th and 90th percentile of each feature by group, one row a group.

    Ranks and means come from windows over the group, which spill, and one aggregate follows in the same
    tasks: a quantile is the sum of the two ranks beside it, weighted by their nearness.
    """
    group = Window.partitionBy(*keys)
    # Given a number, the parts aren't joined again, so that a task's sorts stay small.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).repartition(n, *keys)
    rows = rows.select("*", *[c for f in features for c in (F.avg(f).over(group).alias(f"_m_{f}"), (F.count(f).over(group) - 1).alias(f"_n_{f}"))])
    for f in features:
        rows = rows.withColumn(f"_i_{f}", F.row_number().over(group.orderBy(F.col(f).asc_nulls_last())) - 1)
    out = []
    for f in features:
        near = lambda q: 1 - F.abs(F.col(f"_i_{f}") - q * F.col(f"_n_{f}"))  # noqa: B023, E731
        at = {q: F.sum(F.when(near(q) > 0, F.col(f) * near(q))) for q in (0.1, 0.25, 0.75, 0.9)}
        out += [
            F.avg(f).alias(f"{f}_mean"), F.stddev_samp(f).alias(f"{f}_std"), skew_sample(f).alias(f"{f}_skew"), kurtosis_sample(f).alias(f"{f}_kurt"),
            F.avg(F.abs(F.col(f) - F.col(f"_m_{f}"))).alias(f"{f}_mad"), (at[0.75] - at[0.25]).alias(f"{f}_iqr"), at[0.1].alias(f"{f}_p10"), at[0.9].alias(f"{f}_p90"),
        ]
    return rows.groupBy(*keys).agg(*out)


def movement_gate(df: DataFrame, keys: list[str], more_than: int = 10) -> DataFrame:
    """Rows of groups with more than so many rows."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > more_than).drop("_n")
    return df.join(big, keys, "left_semi")


def intervals_between(bouts: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds from each bout's end to the next one's start: mean, population deviation and variance, coefficient of variation, iqr."""
    w = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    gaps = bouts.withColumn("iei", (F.lead("start_us").over(w) - F.col("end_us")) / SECOND).where("iei is not null")
    return gaps.groupBy(*keys).agg(
        F.avg("iei").alias("iei_mean"), F.stddev_pop("iei").alias("iei_std"), F.var_pop("iei").alias("iei_var"),
        F.when(F.avg("iei") != 0, F.stddev_pop("iei") / F.avg("iei")).alias("iei_cv"), iqr("iei").alias("iei_iqr"),
    )


def durations(bouts: DataFrame, keys: list[str]) -> DataFrame:
    """Distribution of bout seconds, population forms."""
    d = bouts.withColumn("d", (F.col("end_us") - F.col("start_us")) / SECOND)
    return d.groupBy(*keys).agg(
        F.avg("d").alias("dur_mean"), F.stddev_pop("d").alias("dur_std"), skew_population("d").alias("dur_skew"), kurtosis_population("d").alias("dur_kurt"),
        quantile("d", 0.25).alias("dur_q25"), quantile("d", 0.5).alias("dur_q50"), quantile("d", 0.75).alias("dur_q75"),
    )


def moves_per_hour(bouts: DataFrame, keys: list[str]) -> DataFrame:
    span = (F.max("end_us") - F.min("start_us")) / HOUR
    return bouts.groupBy(*keys).agg(F.when(span > 0, F.count(F.lit(1)) / span).alias("n_moves_per_h"), F.count(F.lit(1)).alias("n_moves"))


def unit_midpoints(bouts: DataFrame, keys: list[str]) -> DataFrame:
    """Bout midpoints scaled to 0 .. 1 in their group; groups without spread are left out."""
    m = bouts.withColumn("m", (F.col("start_us") + F.col("end_us")) / 2)
    ends = m.groupBy(*keys).agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("hi > lo")
    return m.join(ends, keys).withColumn("x", (F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo"))).drop("m", "lo", "hi")


def kde_grid(bouts: DataFrame, keys: list[str], bandwidth: float = 0.04, grid: int = 400) -> DataFrame:
    """(keys, g, density): Gaussian kernel density of the scaled midpoints on an even grid of 0 .. 1.

    The grid is exploded from each bout and summed by (group, point); partial sums leave each task
    with a row for each point of a group at most.
    """
    x = unit_midpoints(bouts, keys)
    points = x.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    z = (F.col("g") / (grid - 1) - F.col("x")) / bandwidth
    kernel = F.exp(-0.5 * z * z) / (bandwidth * math.sqrt(2 * math.pi))
    return points.groupBy(*keys, "g").agg(F.avg(kernel).alias("density"))


def kde_peaks(
    bouts: DataFrame, keys: list[str], bandwidth: float = 0.04, grid: int = 400, prominence: float = 0.15, height: float = 0.5, apart: float = 0.1, margin: float = 0.075
) -> DataFrame:
    """(keys, kde_n_peaks, kde_avg_prom, kde_max_prom, kde_min_prom): peaks of the midpoints' density, those near either end left out.

    A group is its ``grid`` densities, however many bouts it has; without a peak all are 0, and groups without spread have no row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, prom = find_peaks(pdf.sort_values("g")["density"].to_numpy(), int(apart * (grid - 1)), prominence, height)
        edge = int(margin * grid)
        prom = prom[(at > edge) & (at < grid - edge)]
        stats = [prom.mean(), prom.max(), prom.min()] if len(prom) else [0.0, 0.0, 0.0]
        return pd.DataFrame([[*pdf[keys].iloc[0], len(prom), *stats]], columns=[*keys, "kde_n_peaks", *names])

    names = ["kde_avg_prom", "kde_max_prom", "kde_min_prom"]
    density = kde_grid(bouts, keys, bandwidth, grid)
    kinds = ", ".join(f"`{k}` {density.schema[k].dataType.simpleString()}" for k in keys)
    return density.groupBy(*keys).applyInPandas(run, f"{kinds}, kde_n_peaks long, " + ", ".join(f"{n} double" for n in names))


def nearest_neighbour_sum(bouts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nn_sum, n): sum over scaled midpoints of the distance to the nearest other one: the data term of the clustering score."""
    x = unit_midpoints(bouts, keys)
    w = Window.partitionBy(*keys).orderBy("x")
    d = F.least(F.col("x") - F.lag("x").over(w), F.lead("x").over(w) - F.col("x"))
    return x.withColumn("d", d).groupBy(*keys).agg(F.sum("d").alias("nn_sum"), F.count(F.lit(1)).alias("n"))


def hopkins(bouts: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """(keys, hopkins): u / (u + w), u and w the summed nearest distances of as many uniform points and of the midpoints.

    The uniform points are hashes of the seed and each row's place, so a rerun draws the same.
    """
    x = unit_midpoints(bouts, keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("x", "start_us"))
    draw = F.pmod(F.xxhash64(F.lit(seed), *keys, place), F.lit(1 << 40)) / F.lit(float(1 << 40))
    both = x.select(*keys, F.col("x").alias("p"), F.lit(False).alias("drawn")).union(x.select(*keys, draw.alias("p"), F.lit(True).alias("drawn")))
    w = Window.partitionBy(*keys).orderBy("p", "drawn")
    data = F.when(~F.col("drawn"), F.col("p"))
    below = F.last(data, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first(data, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = F.least(F.col("p") - below, above - F.col("p"))
    sums = both.withColumn("d", near).groupBy(*keys).agg(F.sum(F.when(F.col("drawn"), F.col("d"))).alias("u"), F.sum(F.when(~F.col("drawn"), F.col("d"))).alias("w"))
    return sums.select(*keys, F.when(F.col("u") + F.col("w") > 0, F.col("u") / (F.col("u") + F.col("w"))).alias("hopkins"))


def sleep_efficiency(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Slept share of each window (``sleep_us``), and its reciprocal under the name that the feature lists use."""
    share = F.col("sleep_us") / (F.col("end_us") - F.col("start_us"))
    return windows.withColumn("sleep_eff", F.when(F.col("end_us") > F.col("start_us"), share)).withColumn("waso", F.when(share > 0, 1 / share)).select(*keys, "sleep_eff", "waso")


def attach_globals(local: DataFrame, global_: DataFrame, keys: list[str]) -> DataFrame:
    """The night table: local aggregates with the global features of the same record and night, where there are any."""
    return local.join(global_, keys, "left")


def patient_means(df: DataFrame, key: str, features: list[str], strings: list[str] = ()) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(f).alias(f) for f in features], *[F.min(s).alias(s) for s in strings])
