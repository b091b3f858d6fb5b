"""Features of one movement bout's samples, as SQL over (bout, i, v) rows or over whole arrays.

A bout is short (its length is gated), so array expressions work on one row and shuffle nothing;
features that need order statistics explode the array and group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import kurtosis_population, quantile, skew_population


def samples(df: DataFrame, key: str, array: str) -> DataFrame:
    """(key, i, v): a row for each sample; a null or empty array has none."""
    return df.select(key, F.posexplode(array).alias("i", "v")).withColumn("v", F.col("v").cast("double"))


def moments(rows: DataFrame, key: str) -> DataFrame:
    """Mean, population deviation, biased skewness and excess kurtosis."""
    return rows.groupBy(key).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), skew_population("v").alias("skew"), kurtosis_population("v").alias("kurt"))


def quantiles(rows: DataFrame, key: str) -> DataFrame:
    q = rows.groupBy(key).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(key, "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q75"), "max", (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def total(a: Column, f) -> Column:
    return F.aggregate(F.transform(a, f), F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a, lambda v: v.cast("double")) / F.size(a)


def energy(a: Column) -> dict[str, Column]:
    """Signal magnitude area, mean power and root mean square."""
    power = total(a, lambda v: v.cast("double") * v) / F.size(a)
    return {"sma": total(a, lambda v: F.abs(v.cast("double"))), "power": power, "rms": F.sqrt(power)}


def autocorrelation(a: Column, lag: int) -> Column:
    """Autocovariance at the lag over the variance; null without spread."""
    m = mean(a)
    d = F.transform(a, lambda v: v.cast("double") - m)
    ahead = F.slice(d, lag + 1, F.greatest(F.size(a) - lag, F.lit(0)))
    cross = F.aggregate(F.zip_with(F.slice(d, 1, F.greatest(F.size(a) - lag, F.lit(0))), ahead, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    own = total(d, lambda v: v * v)
    return F.when(own > 0, cross / own)


def zero_crossings(a: Column) -> Column:
    """Changes of the sign bit between neighbours."""
    neg = F.transform(a, lambda v: (v < 0).cast("int"))
    return F.aggregate(
        F.zip_with(F.slice(neg, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(neg, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.abs(x - y)),
        F.lit(0), lambda s, v: s + v,
    )


def dft_power(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, bin, power): periodogram of the mean-free samples at bins 1 .. n / 2."""
    centred = rows.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy(key)))
    bins = centred.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(n // 2))))
    angle = F.col("i") * F.col("bin") * (2 * math.pi / n)
    parts = bins.groupBy(key, "bin").agg(F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im"))
    return parts.select(key, "bin", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n).alias("power"))


def top_bins(powers: DataFrame, key: str, k: int = 3) -> DataFrame:
    """The ``k`` strongest bins; equally strong: the lower."""
    w = Window.partitionBy(key).orderBy(F.desc("power"), "bin")
    return powers.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def local_peaks(rows: DataFrame, key: str) -> DataFrame:
    """(key, i, v, prominence): samples above both neighbours, and how far one must go down to reach a higher one (or the end).

    The higher of the two lowest points on the way to the next higher sample on either side.
    """
    w = Window.partitionBy(key).orderBy("i")
    marked = rows.withColumn("p", F.lag("v").over(w)).withColumn("n", F.lead("v").over(w))
    peaks = marked.where("v > p and v > n").select(key, "i", "v")
    other = rows.select(F.col(key).alias("_k"), F.col("i").alias("j"), F.col("v").alias("u"))
    pairs = peaks.join(other, F.col(key) == F.col("_k"))
    edge = pairs.groupBy(key, "i", "v").agg(
        F.max(F.when((F.col("u") > F.col("v")) & (F.col("j") < F.col("i")), F.col("j"))).alias("left"),
        F.min(F.when((F.col("u") > F.col("v")) & (F.col("j") > F.col("i")), F.col("j"))).alias("right"),
    )
    span = edge.join(other, F.col(key) == F.col("_k"))
    lows = span.groupBy(key, "i", "v").agg(
        F.min(F.when((F.col("j") <= F.col("i")) & (F.col("j") > F.coalesce("left", F.lit(-1))), F.col("u"))).alias("lo"),
        F.min(F.when((F.col("j") >= F.col("i")) & (F.col("j") < F.coalesce("right", F.lit(1 << 30))), F.col("u"))).alias("hi"),
    )
    return lows.select(key, "i", "v", (F.col("v") - F.greatest("lo", "hi")).alias("prominence"))


def poincare(a: Column) -> dict[str, Column]:
    """Short and long term spread of the return map: population deviations across and along the diagonal, ratio and ellipse area."""
    x, y = F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1)

    def spread(sign: int) -> Column:
        d = F.zip_with(y, x, lambda q, p: (q.cast("double") + sign * p) / math.sqrt(2))
        m = mean(d)
        return F.sqrt(total(d, lambda v: (v - m) * (v - m)) / F.size(d))

    sd1, sd2 = spread(-1), spread(1)
    return {"sd1": sd1, "sd2": sd2, "sd_ratio": F.when(sd1 > 0, sd2 / sd1), "ellipse_area": math.pi * sd1 * sd2}


def sample_entropy(rows: DataFrame, key: str, m: int = 3, tolerance: float = 0.2) -> DataFrame:
    """(key, sampen): -ln of the share of template matches of ``m`` samples that go on to ``m + 1``; null without matches.

    Templates match if no sample differs by more than ``tolerance`` deviations (sample form).
    """
    w = Window.partitionBy(key)
    o = w.orderBy("i")
    t = rows.withColumn("r", F.stddev_samp("v").over(w) * tolerance)
    for j in range(1, m + 1):
        t = t.withColumn(f"v{j}", F.lead("v", j).over(o))
    t = t.where(f"v{m} is not null").withColumnRenamed("v", "v0")
    a, b = t.alias("a"), t.select(F.col(key).alias("_k"), F.col("i").alias("j"), *[F.col(f"v{j}").alias(f"u{j}") for j in range(m + 1)]).alias("b")
    pairs = a.join(b, (F.col(key) == F.col("_k")) & (F.col("i") < F.col("j")))
    near = lambda j: F.abs(F.col(f"v{j}") - F.col(f"u{j}")) <= F.col("r")
    short = near(0)
    for j in range(1, m):
        short = short & near(j)
    counts = pairs.groupBy(key).agg(F.sum(short.cast("int")).alias("nb"), F.sum((short & near(m)).cast("int")).alias("na"))
    return counts.select(key, F.when((F.col("na") > 0) & (F.col("nb") > 0), -F.log(F.col("na") / F.col("nb"))).alias("sampen"))


def length_gate(n: Column, rate_hz: float, least_s: float = 0.5, most_s: float = 50.0) -> Column:
    """Whether a bout of ``n`` samples is long enough for features, and not too long."""
    return n.between(int(least_s * rate_hz), int(most_s * rate_hz))


__all__ = ["autocorrelation", "dft_power", "energy", "length_gate", "local_peaks", "moments", "poincare", "quantile", "quantiles", "sample_entropy", "samples", "top_bins", "zero_crossings"]
