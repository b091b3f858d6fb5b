"""Significance of differences between two groups, and of departures from the normal distribution.

Statistics come from aggregates and running totals over all rows; their p-values are column
expressions over a row a feature: the incomplete beta function by its continued fraction and the normal
tail by a series and a continued fraction, each with a fixed number of steps.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .evaluation import dealt, running_totals
from .ranking import long_features, ranked

#: Steps of the continued fractions and series.
STEPS = 400
_TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series at z + 8, and back by eight steps."""
    up = z + 8
    series = (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * F.pow(up, 5)) - 1 / (1680 * F.pow(up, 7))
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    return series - F.log(product)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its head on (both partial quotients of a step at once)."""
    # In each step c and d are the ratios of successive numerators and denominators; none may vanish.
    kept = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def one(state: Column, quotient: Column) -> tuple[Column, Column, Column]:
        d = 1 / kept(1 + quotient * state["d"])
        c = kept(1 + quotient / state["c"])
        return c, d, state["h"] * c * d

    def pack(c: Column, d: Column, h: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def even(state: Column, m: Column) -> Column:
        return pack(*one(state, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))))

    def odd(state: Column, m: Column) -> Column:
        return pack(*one(state, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))))

    d0 = 1 / kept(1 - (a + b) * x / (a + 1))
    start = pack(F.lit(1.0), d0, d0)
    steps = F.sequence(F.lit(2), F.lit(2 * STEPS + 1))
    # Even numbers 2m are the first half of step m, odd ones the second.
    half = lambda i: F.floor(i / 2).cast("double")
    return F.aggregate(steps, start, lambda s, i: F.when(i % 2 == 0, even(s, half(i))).otherwise(odd(s, half(i))))["h"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function of 0 <= x <= 1."""
    a, b, x = (v.cast("double") for v in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    value = front * _fraction(p, q, y) / p
    inside = F.when(swap, 1 - value).otherwise(value)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def t_tails(t: Column, freedom: Column) -> Column:
    """Chance that Student's t lies farther from 0 than ``t``."""
    return incomplete_beta(freedom / 2, F.lit(0.5), freedom / (freedom + t * t))


def normal_tails(z: Column) -> Column:
    """Chance that a standard normal number lies farther from 0 than ``z``."""
    x = F.abs(z.cast("double"))
    near = F.least(x, F.lit(4.0))
    # Inside: a series of positive terms; outside: the continued fraction of the tail, from its end.
    term = F.aggregate(
        F.sequence(F.lit(1), F.lit(120)), F.struct(near.alias("t"), near.alias("s")),
        lambda a, k: F.struct((a["t"] * near * near / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * near * near / (2 * k + 1)).alias("s")),
    )["s"]
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    inner = 1 - 2 * density * term
    far = F.greatest(x, F.lit(2.5))
    down = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), far, lambda v, k: far + k / v)
    return F.when(x < 2.5, inner).otherwise(2 * density / down)


@F.pandas_udf(DoubleType())
def normal_below(z: pd.Series) -> pd.Series:
    """Chance that a standard normal number is at most ``z``, for long columns: an Arrow batch at a time."""
    return pd.Series([0.5 * math.erfc(-x / math.sqrt(2)) for x in z.tolist()])


def fisher_combined(p: Column, q: Column) -> Column:
    """One chance from two by Fisher's method: the chi-square tail of four degrees of freedom in closed form; 0 if either is."""
    both = p * q
    return F.when(both <= 0, F.lit(0.0)).otherwise(both * (1 - F.log(F.when(both > 0, both))))


def group_statistics(df: DataFrame, features: list[str], group: str, a, b) -> DataFrame:
    """(feature, t, dof, t_p, u, z, u_p, n_a, n_b): Welch's t and Mann-Whitney's U of group ``a`` against ``b``.

    U's chance is the normal one with corrections for ties and continuity, both sides.  Nulls and
    other groups take no part.  A statistic that the data don't define (a group of fewer than two rows, no
    spread) is null, and so is its chance.
    """
    both = df.where(F.col(group).isin(a, b))
    rows = long_features(both, features, group).where("value is not null")
    spread_out = long_features(dealt(both, *dict.fromkeys([*features, group])), features, group).where("value is not null")
    counts = spread_out.groupBy("feature", "value").agg(F.sum((F.col(group) == a).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    cum = running_totals(counts, ["feature"], "value", ["n"], descending=False)
    rank = F.col("cum_n") - (F.col("n") - 1) / 2
    d = lambda c: F.col(c).cast("double")
    sums = cum.groupBy("feature").agg(
        F.sum("pos").alias("n_a"), F.sum(F.col("n") - F.col("pos")).alias("n_b"), F.sum(F.col("pos") * rank).alias("ranks"), F.sum(d("n") * d("n") * d("n") - d("n")).alias("ties")
    )
    of = lambda side, f: f(F.when(F.col(group) == side, F.col("value")))
    moments = rows.groupBy("feature").agg(*[of(g, f).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("m", F.avg), ("v", F.var_samp))])
    s = sums.join(moments, "feature")
    na, nb, total = d("n_a"), d("n_b"), d("n_a") + d("n_b")
    e0, e1 = F.col("v0") / na, F.col("v1") / nb
    spread = (F.col("n_a") > 1) & (F.col("n_b") > 1) & (e0 + e1 > 0)
    t = F.when(spread, (F.col("m0") - F.col("m1")) / F.sqrt(F.when(spread, e0 + e1)))
    dof = F.when(spread, F.pow(e0 + e1, 2) / (e0 * e0 / (na - 1) + e1 * e1 / (nb - 1)))
    u = F.col("ranks") - na * (na + 1) / 2
    variance = na * nb / 12 * (total + 1 - F.col("ties") / (total * (total - 1)))
    defined = (F.col("n_a") > 0) & (F.col("n_b") > 0) & (variance > 0)
    z = F.when(defined, (F.greatest(u, na * nb - u) - na * nb / 2 - 0.5) / F.sqrt(F.when(defined, variance)))
    s = s.select("feature", t.alias("t"), dof.alias("dof"), u.alias("u"), z.alias("z"), "n_a", "n_b")
    chance = lambda z: F.least(F.when(z < 0, F.lit(1.0)).otherwise(normal_tails(z)), F.lit(1.0))
    return s.select("feature", "t", "dof", F.when(F.col("t").isNotNull(), t_tails(F.col("t"), F.col("dof"))).alias("t_p"), "u", "z", F.when(F.col("z").isNotNull(), chance(F.col("z"))).alias("u_p"), "n_a", "n_b")


def rank_significance(df: DataFrame, features: list[str], group: str, a, b) -> DataFrame:
    """(feature, t_p, u_p, combined_p, rank): both tests' chances, combined by Fisher's method and ranked, ties at the highest rank.

    A feature without a combined chance has the last rank.
    """
    s = group_statistics(df, features, group, a, b)
    s = s.select("feature", "t_p", "u_p", fisher_combined(F.col("t_p"), F.col("u_p")).alias("combined_p"))
    # Chances above 1 don't occur, so those without one come last.
    out = ranked(s, F.coalesce("combined_p", F.lit(2.0)))
    n = s.agg(F.count(F.lit(1)).alias("_n"))
    return out.crossJoin(F.broadcast(n)).withColumn("rank", F.when(F.col("combined_p").isNull(), F.col("_n")).otherwise(F.col("rank")).cast("long")).drop("_n")  # one row


def normal_distance(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, feature, n, distance, p): Kolmogorov-Smirnov distance of each feature from the normal distribution of its mean and deviation.

    The empirical distribution is a running total over distinct values; ``p`` is the limit
    distribution's with the usual correction for finite n.  Null for fewer than two values or no spread.
    """
    keys = list(keys)
    rows = long_features(df, features, *keys).where("value is not null")
    by = [*keys, "feature"]
    m = rows.groupBy(*by).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("total"))
    spread_out = long_features(dealt(df, *dict.fromkeys([*features, *keys])), features, *keys).where("value is not null")
    cum = running_totals(spread_out.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")), by, "value", ["n"], descending=False)
    j = cum.join(m, by)
    ok = (F.col("total") > 1) & (F.col("s") > 0)
    z = F.when(ok, (F.col("value") - F.col("m")) / F.when(ok, F.col("s")))
    # A chance for each distinct value: here the series' hundreds of steps would cost more than a batch does.
    below = F.when(z.isNotNull(), normal_below(F.coalesce(z, F.lit(0.0))))
    upto, before = F.col("cum_n") / F.col("total"), (F.col("cum_n") - F.col("n")) / F.col("total")
    found = j.groupBy(*by, "total").agg(F.max(F.greatest(upto - below, below - before)).alias("distance"))
    root = F.sqrt(F.col("total").cast("double"))
    x = (root + 0.12 + 0.11 / root) * F.col("distance")
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * x * x))
    p = F.when(F.col("distance").isNotNull(), F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0))))
    return found.select(*keys, "feature", F.col("total").alias("n"), "distance", p.alias("p"))
