"""Queries over ``embeddings`` (64 samples: one bout) and over bouts of ``events`` by user and day."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.columns import DAY, HOUR, day_of
from tidemark.operators import arrays as A
from tidemark.operators import nights as N

from .catalogue import register
from .series_queries import BOUTS, E, bouts, events, merged, r, table, MERGED

X = "x AS (SELECT vec_id, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def samples(spark, sf_dir):
    return A.samples(vectors(spark, sf_dir), "vec_id", "embedding")


@register(
    "moments_local",
    f"""WITH {X}, m AS (SELECT vec_id, avg(v) AS m FROM x GROUP BY vec_id)
SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(avg((v - m) ** 3) / stddev_pop(v) ** 3, 5) AS skew, round(avg((v - m) ** 4) / stddev_pop(v) ** 4 - 3, 5) AS kurt FROM x JOIN m USING (vec_id) GROUP BY vec_id""",
)
def moments_local(spark, sf_dir):
    return A.moments(samples(spark, sf_dir), "vec_id").select("vec_id", r("mean").alias("mean"), r("std").alias("std"), r("skew", 5).alias("skew"), r("kurt", 5).alias("kurt"))


@register(
    "quantiles_local",
    f"""WITH {X}, q AS (SELECT vec_id, min(v) AS mn, max(v) AS mx, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM x GROUP BY vec_id)
SELECT vec_id, round(mn, 6) AS min, round(a, 6) AS q25, round(b, 6) AS med, round(c, 6) AS q75, round(mx, 6) AS max, round(c - a, 6) AS iqr FROM q""",
)
def quantiles_local(spark, sf_dir):
    q = A.quantiles(samples(spark, sf_dir), "vec_id")
    return q.select("vec_id", *[r(c).alias(c) for c in q.columns[1:]])


@register("energy_local", f"WITH {X} SELECT vec_id, round(sum(abs(v)), 6) AS sma, round(avg(v * v), 6) AS power, round(sqrt(avg(v * v)), 6) AS rms FROM x GROUP BY vec_id")
def energy_local(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", *[r(c).alias(n) for n, c in A.energy(F.col("embedding")).items()])


_LAGS = (1, 2, 5, 10)
_ACF = ", ".join(f"round(sum(d * lead{k}) / sum(d * d), 6) AS acf_{k}" for k in _LAGS)


@register(
    "acf_lags",
    f"""WITH {X}, d AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS d FROM x),
l AS (SELECT vec_id, d, {", ".join(f"lead(d, {k}) OVER (PARTITION BY vec_id ORDER BY i) AS lead{k}" for k in _LAGS)} FROM d) SELECT vec_id, {_ACF} FROM l GROUP BY vec_id""",
)
def acf_lags(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", *[r(A.autocorrelation(F.col("embedding"), k)).alias(f"acf_{k}") for k in _LAGS])


@register(
    "acf_zero_crossings",
    f"WITH {X}, l AS (SELECT vec_id, v, lead(v) OVER (PARTITION BY vec_id ORDER BY i) AS n FROM x) SELECT vec_id, count(*) FILTER (n IS NOT NULL AND (v < 0) <> (n < 0)) AS zeros FROM l GROUP BY vec_id",
)
def acf_zero_crossings(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", A.zero_crossings(F.col("embedding")).cast("long").alias("zeros"))


POWER = f"""{X}, d AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS d FROM x),
p AS (SELECT vec_id, k AS bin, (sum(d * cos(i * k * {2 * math.pi / 64!r})) ** 2 + sum(d * sin(i * k * {2 * math.pi / 64!r})) ** 2) / 64 AS power FROM d, (SELECT unnest(range(1, 33)) AS k) GROUP BY vec_id, k)"""


@register("dft_power_bins", f"WITH {POWER} SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(power, 5) AS power FROM p")
def dft_power_bins(spark, sf_dir):
    return A.dft_power(samples(spark, sf_dir), "vec_id", 64).select("vec_id", "bin", r("power", 5).alias("power"))


@register(
    "spectral_topk",
    f"WITH {POWER}, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY power DESC, bin) AS place FROM p) SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(power, 5) AS power, CAST(place AS INTEGER) AS place FROM k WHERE place <= 3",
)
def spectral_topk(spark, sf_dir):
    top = A.top_bins(A.dft_power(samples(spark, sf_dir), "vec_id", 64), "vec_id")
    return top.select("vec_id", "bin", r("power", 5).alias("power"), "place")


@register(
    "local_peaks",
    f"""WITH {X}, n AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i)), pk AS (SELECT vec_id, i, v FROM n WHERE v > p AND v > q),
ed AS (SELECT pk.vec_id, pk.i, pk.v, max(x.i) FILTER (x.v > pk.v AND x.i < pk.i) AS l, min(x.i) FILTER (x.v > pk.v AND x.i > pk.i) AS r FROM pk JOIN x ON x.vec_id = pk.vec_id GROUP BY pk.vec_id, pk.i, pk.v),
lo AS (SELECT ed.vec_id, ed.i, ed.v, min(x.v) FILTER (x.i <= ed.i AND x.i > coalesce(l, -1)) AS a, min(x.v) FILTER (x.i >= ed.i AND x.i < coalesce(r, 100000)) AS b FROM ed JOIN x ON x.vec_id = ed.vec_id GROUP BY ed.vec_id, ed.i, ed.v)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(v - greatest(a, b), 6) AS prominence FROM lo""",
)
def local_peaks(spark, sf_dir):
    return A.local_peaks(samples(spark, sf_dir), "vec_id").select("vec_id", "i", r("prominence").alias("prominence"))


@register(
    "poincare_sd",
    f"""WITH {X}, l AS (SELECT vec_id, v, lead(v) OVER (PARTITION BY vec_id ORDER BY i) AS n FROM x),
s AS (SELECT vec_id, stddev_pop((n - v) / sqrt(2)) AS sd1, stddev_pop((n + v) / sqrt(2)) AS sd2 FROM l WHERE n IS NOT NULL GROUP BY vec_id)
SELECT vec_id, round(sd1, 6) AS sd1, round(sd2, 6) AS sd2, round(sd2 / sd1, 6) AS sd_ratio, round(pi() * sd1 * sd2, 6) AS ellipse_area FROM s""",
)
def poincare_sd(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", *[r(c).alias(n) for n, c in A.poincare(F.col("embedding")).items()])


@register(
    "sample_entropy_m2",
    f"""WITH {X}, t AS (SELECT vec_id, i, v AS a, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c, 0.5 * stddev_samp(v) OVER (PARTITION BY vec_id) AS r FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
u AS (SELECT * FROM t WHERE c IS NOT NULL),
p AS (SELECT s.vec_id, sum(CASE WHEN abs(s.a - o.a) <= s.r AND abs(s.b - o.b) <= s.r THEN 1 ELSE 0 END) AS nb, sum(CASE WHEN abs(s.a - o.a) <= s.r AND abs(s.b - o.b) <= s.r AND abs(s.c - o.c) <= s.r THEN 1 ELSE 0 END) AS na
 FROM u s JOIN u o ON s.vec_id = o.vec_id AND s.i < o.i GROUP BY s.vec_id)
SELECT vec_id, CASE WHEN na > 0 AND nb > 0 THEN round(-ln(na / nb), 6) END AS sampen FROM p""",
)
def sample_entropy_m2(spark, sf_dir):
    return A.sample_entropy(samples(spark, sf_dir), "vec_id", 2, 0.5).select("vec_id", r("sampen").alias("sampen"))


def by_day(spark, sf_dir):
    return events(spark, sf_dir).withColumn("day", F.floor(day_of(F.col("us")) / 7))


_G = "avg(d * d)"


@register(
    "night_agg_8stats",
    f"""WITH {E}, g AS (SELECT user_id, us // {7 * DAY} AS day, value AS v FROM e), m AS (SELECT user_id, day, avg(v) AS m FROM g GROUP BY user_id, day)
SELECT user_id, day, round(avg(v), 9) AS value_mean, round(stddev_samp(v), 9) AS value_std, round(skewness(v), 5) AS value_skew, round(kurtosis(v), 5) AS value_kurt, round(avg(abs(v - m)), 9) AS value_mad,
 round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 9) AS value_iqr, round(quantile_cont(v, 0.1), 9) AS value_p10, round(quantile_cont(v, 0.9), 9) AS value_p90 FROM g JOIN m USING (user_id, day) GROUP BY user_id, day""",
)
def night_agg_8stats(spark, sf_dir):
    out = N.eight_statistics(by_day(spark, sf_dir), ["user_id", "day"], ["value"])
    return out.select("user_id", "day", *[r(c, 5 if c.endswith(("skew", "kurt")) else 9).alias(c) for c in out.columns[2:]])


@register(
    "iei_stats",
    f"""WITH {BOUTS}, g AS (SELECT user_id, (lead(start_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us) - end_us) / 1000000.0 AS iei FROM b)
SELECT user_id, round(avg(iei), 4) AS iei_mean, round(stddev_pop(iei), 4) AS iei_std, round(var_pop(iei) / 1e6, 4) AS iei_var, round(stddev_pop(iei) / avg(iei), 6) AS iei_cv, round(quantile_cont(iei, 0.75) - quantile_cont(iei, 0.25), 4) AS iei_iqr FROM g WHERE iei IS NOT NULL GROUP BY user_id""",
)
def iei_stats(spark, sf_dir):
    s = N.intervals_between(bouts(spark, sf_dir), ["user_id"])
    return s.select("user_id", r("iei_mean", 4).alias("iei_mean"), r("iei_std", 4).alias("iei_std"), r(F.col("iei_var") / 1e6, 4).alias("iei_var"), r("iei_cv").alias("iei_cv"), r("iei_iqr", 4).alias("iei_iqr"))


@register(
    "duration_stats",
    f"""WITH {BOUTS}, d AS (SELECT user_id, (end_us - start_us) / 1000000.0 AS d FROM b), m AS (SELECT user_id, avg(d) AS m, stddev_pop(d) AS s FROM d GROUP BY user_id)
SELECT user_id, round(avg(d), 4) AS dur_mean, round(stddev_pop(d), 4) AS dur_std, CASE WHEN any_value(s) > 0 THEN round(avg(((d - m) / nullif(s, 0)) ** 3), 5) END AS dur_skew, CASE WHEN any_value(s) > 0 THEN round(avg(((d - m) / nullif(s, 0)) ** 4) - 3, 5) END AS dur_kurt,
 round(quantile_cont(d, 0.25), 4) AS dur_q25, round(quantile_cont(d, 0.5), 4) AS dur_q50, round(quantile_cont(d, 0.75), 4) AS dur_q75 FROM d JOIN m USING (user_id) GROUP BY user_id""",
)
def duration_stats(spark, sf_dir):
    s = N.durations(bouts(spark, sf_dir), ["user_id"])
    return s.select("user_id", *[r(c, 5 if c.endswith(("skew", "kurt")) else 4).alias(c) for c in s.columns[1:]])


@register("moves_per_hour", f"WITH {BOUTS} SELECT user_id, round(count(*) / ((max(end_us) - min(start_us)) / {HOUR}.0), 6) AS n_moves_per_h, count(*) AS n_moves FROM b GROUP BY user_id")
def moves_per_hour(spark, sf_dir):
    m = N.moves_per_hour(bouts(spark, sf_dir), ["user_id"])
    return m.select("user_id", r("n_moves_per_h").alias("n_moves_per_h"), "n_moves")


@register("movement_gate", f"WITH {BOUTS} SELECT user_id, session::BIGINT AS session FROM b WHERE user_id IN (SELECT user_id FROM b GROUP BY user_id HAVING count(*) > 16)")
def movement_gate(spark, sf_dir):
    return N.movement_gate(bouts(spark, sf_dir), ["user_id"], 16).select("user_id", F.col("session").cast("long"))


MID = f"{BOUTS}, md AS (SELECT user_id, start_us, (start_us + end_us) / 2 AS m FROM b), en AS (SELECT user_id, min(m) AS lo, max(m) AS hi FROM md GROUP BY user_id HAVING max(m) > min(m)), xx AS (SELECT user_id, (m - lo) / (hi - lo) AS x FROM md JOIN en USING (user_id))"


@register(
    "kde_grid_density",
    f"WITH {MID} SELECT user_id, CAST(g AS INTEGER) AS g, round(avg(exp(-0.5 * ((g / 399 - x) / 0.04) ** 2) / (0.04 * sqrt(2 * pi()))), 5) AS density FROM xx, (SELECT unnest(range(0, 400)) AS g) GROUP BY user_id, g",
)
def kde_grid_density(spark, sf_dir):
    return N.kde_grid(bouts(spark, sf_dir), ["user_id"]).select("user_id", "g", r("density", 5).alias("density"))


@register(
    "hopkins_nn_term",
    f"WITH {MID}, d AS (SELECT user_id, least(x - lag(x) OVER w, lead(x) OVER w - x) AS d FROM xx WINDOW w AS (PARTITION BY user_id ORDER BY x)) SELECT user_id, round(sum(d), 6) AS nn_sum, count(*) AS n FROM d GROUP BY user_id",
)
def hopkins_nn_term(spark, sf_dir):
    return N.nearest_neighbour_sum(bouts(spark, sf_dir), ["user_id"]).select("user_id", r("nn_sum").alias("nn_sum"), "n")


@register("hopkins_score")
def hopkins_score(spark, sf_dir):
    return N.hopkins(bouts(spark, sf_dir), ["user_id"])


@register(
    "sleep_efficiency",
    f"""WITH {MERGED}, sl AS (SELECT iv.user_id, iv.start_us, iv.end_us, sum(b.end_us - b.start_us) AS sleep_us FROM iv JOIN b ON b.user_id = iv.user_id AND b.start_us >= iv.start_us AND b.end_us <= iv.end_us GROUP BY ALL)
SELECT user_id, start_us, round(sleep_us / (end_us - start_us), 6) AS sleep_eff, CASE WHEN sleep_us > 0 THEN round(1 / (sleep_us / (end_us - start_us)), 6) END AS waso FROM sl""",
)
def sleep_efficiency(spark, sf_dir):
    b = bouts(spark, sf_dir).select("user_id", F.col("start_us").alias("bs"), F.col("end_us").alias("be"))
    w = merged(spark, sf_dir).join(b, "user_id").where("bs >= start_us and be <= end_us")
    slept = w.groupBy("user_id", "start_us", "end_us").agg(F.sum(F.col("be") - F.col("bs")).alias("sleep_us"))
    return N.sleep_efficiency(slept, ["user_id", "start_us"]).select("user_id", "start_us", r("sleep_eff").alias("sleep_eff"), r("waso").alias("waso"))


@register(
    "night_table",
    f"""WITH {BOUTS}, l AS (SELECT user_id, avg(top) AS top_mean FROM b GROUP BY user_id), g AS (SELECT user_id, count(*) AS n_moves FROM b GROUP BY user_id HAVING count(*) > 16)
SELECT user_id, round(top_mean, 6) AS top_mean, n_moves FROM l LEFT JOIN g USING (user_id)""",
)
def night_table(spark, sf_dir):
    b = bouts(spark, sf_dir)
    local = b.groupBy("user_id").agg(r(F.avg("top")).alias("top_mean"))
    return N.attach_globals(local, N.moves_per_hour(N.movement_gate(b, ["user_id"], 16), ["user_id"]).select("user_id", "n_moves"), ["user_id"])


@register("length_gate", "SELECT vec_id, len(embedding) BETWEEN 50 AND 5000 AS gated FROM embeddings")
def length_gate(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", A.length_gate(F.size("embedding"), 100.0).alias("gated"))
