"""Queries over recordings' clocks and rates, neighbours and significance.

A recording is a user's events whose clock runs in tenths of seconds where the events' runs in hours;
its header states a rate, except for every fourth user.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.operators import evaluation as V
from tidemark.operators import neighbours as N
from tidemark.operators import recordings as G
from tidemark.operators import selection as X
from tidemark.operators import significance as Z

from .catalogue import register
from .evaluation_queries import CURVE, D, scored
from .series_queries import r, table

# Gaps are at most 60 s, as a rate is told from shorter ones; the header's rate is from another rule than the data's.
INFO = """i AS (
  SELECT user_id, count(*) AS n, min(us) AS start_us, max(us) AS last_us, round(1 / avg(gap / 1e6) FILTER (gap > 0 AND gap <= 60000000), 2) AS data_hz,
    coalesce(min(gap) FILTER (gap > 0) = max(gap), FALSE) AS uniform, CASE WHEN user_id % 4 > 0 THEN 10.0::DOUBLE * (user_id % 3 + 1) END AS header_hz
  FROM (SELECT user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM (SELECT user_id, epoch_us(ts) // 360000 AS us FROM events GROUP BY ALL HAVING count(*) = 1))
  GROUP BY user_id
)"""
# The multiple of ten near the data's rate; the header's where they are over a tenth of it apart.
TARGET = """t AS (
  SELECT *, CASE WHEN near IS NULL OR abs(header_hz - near) > 0.1 * header_hz THEN coalesce(header_hz, near) ELSE near END AS target FROM (
    SELECT *, CASE WHEN data_hz < 5 THEN data_hz WHEN data_hz % 10 < 5 THEN floor(data_hz / 10) * 10 ELSE ceil(data_hz / 10) * 10 END AS near FROM i)
)"""


def clocks(spark, sf_dir):
    us = F.floor(micros("ts") / 360_000).alias("us")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias(G.KEY), us, *[F.col("value").alias(a) for a in G.AXES])
    heads = e.where("recording_id % 4 > 0").select(G.KEY, (10.0 * (F.col(G.KEY) % 3 + 1)).alias("header_hz")).distinct()
    return e, heads


@register("recording_info", f"WITH {INFO} SELECT user_id AS recording_id, n, start_us, last_us + coalesce(round(1e6 / data_hz), 0)::BIGINT AS end_us, data_hz, uniform, header_hz FROM i")
def recording_info(spark, sf_dir):
    e, heads = clocks(spark, sf_dir)
    return G.load(e, heads, time="us")[1]


@register("recording_rates", f"WITH {INFO}, {TARGET} SELECT user_id AS recording_id, NOT uniform AND target IS NOT NULL AS resample, CASE WHEN NOT uniform AND target IS NOT NULL THEN target ELSE coalesce(data_hz, header_hz) END AS hz, coalesce(CASE WHEN NOT uniform THEN target ELSE data_hz END <> header_hz, FALSE) AS differs FROM t")
def recording_rates(spark, sf_dir):
    e, heads = clocks(spark, sf_dir)
    return G.even(*G.load(e, heads, time="us"))[1]


@register(
    "resampled_grid",
    f"WITH {INFO}, {TARGET} SELECT user_id AS recording_id, CAST(floor((last_us - start_us) / round(1e6 / target)) + 1 AS BIGINT) AS n, start_us AS first_us, CAST(start_us + floor((last_us - start_us) / round(1e6 / target)) * round(1e6 / target) AS BIGINT) AS last_us, target AS hz FROM t WHERE NOT uniform AND target IS NOT NULL",
)
def resampled_grid(spark, sf_dir):
    """Rows, ends and rate of the recordings put on an even grid, each at its own rate."""
    e, heads = clocks(spark, sf_dir)
    series, info = G.load(e, heads, time="us")
    rows, rates = G.even(series, info)
    chosen = rows.join(rates.where("resample").select(G.KEY), G.KEY, "left_semi")
    return chosen.groupBy(G.KEY).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("hz").alias("hz"))


@register("resample_decision", f"WITH {INFO} SELECT user_id, (NOT uniform OR data_hz IS NULL OR abs(data_hz - 20) > 1e-8 + 20e-5) AS resample, CASE WHEN abs(header_hz - 20) > 0.1 * header_hz THEN header_hz ELSE 20.0::DOUBLE END AS hz FROM i")
def resample_decision(spark, sf_dir):
    e, heads = clocks(spark, sf_dir)
    found = X.resample_decisions(G.load(e, heads, time="us")[1], G.KEY, "data_hz", "uniform", 20.0, "header_hz")
    return found.withColumnRenamed(G.KEY, "user_id")


@register("final_rate", f"WITH {INFO} SELECT user_id, coalesce(CASE WHEN user_id % 5 > 0 THEN data_hz END, header_hz) AS hz, user_id % 5 > 0 AND coalesce(data_hz <> header_hz, FALSE) AS differs FROM i WHERE (user_id % 5 > 0 AND data_hz IS NOT NULL) OR header_hz IS NOT NULL")
def final_rate(spark, sf_dir):
    """The rate of the data, unknown for every fifth user; recordings of which neither is known are an error and left out before."""
    e, heads = clocks(spark, sf_dir)
    info = G.load(e, heads, time="us")[1].withColumn("data_hz", F.when(F.col(G.KEY) % 5 > 0, F.col("data_hz")))
    return X.final_rate(info.where("data_hz is not null or header_hz is not null"), G.KEY, "data_hz", "header_hz").withColumnRenamed(G.KEY, "user_id")


@register(
    "nearest_parts",
    """WITH p AS (SELECT p_partkey AS id, p_size / 10.0::DOUBLE AS a, p_retailprice / 100 AS b, (p_partkey % 7)::DOUBLE AS c FROM part),
d AS (SELECT q.id AS query, p.id AS neighbour, sqrt((q.a - p.a) * (q.a - p.a) + (q.b - p.b) * (q.b - p.b) + (q.c - p.c) * (q.c - p.c)) AS distance FROM p AS q, p WHERE q.id % 100 = 0 AND q.id <> p.id)
SELECT query, CAST(place AS INTEGER) AS place, neighbour, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS place FROM d) WHERE place <= 5""",
)
def nearest_parts(spark, sf_dir):
    """The five nearest of every row whose id is divisible by 100, against all rows."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 10).alias("a"), (F.col("p_retailprice") / 100).alias("b"), (F.col("p_partkey") % 7).cast("double").alias("c"))
    found = N.nearest(p.where("id % 100 = 0"), p, "id", ["a", "b", "c"])
    return found.select("query", "place", "neighbour", r("distance").alias("distance"))


FEATURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
# Chances by Simpson's rule over the densities, 20,000 steps.
SIGNIFICANCE = f"""WITH x AS ({" UNION ALL ".join(f"SELECT '{k}' AS feature, {c}::DOUBLE AS v, l_returnflag = 'R' AS a FROM lineitem WHERE l_returnflag IN ('R', 'A')" for k, c in FEATURES.items())}),
m AS (SELECT feature, avg(v) FILTER (a) AS m0, avg(v) FILTER (NOT a) AS m1, var_samp(v) FILTER (a) / count(*) FILTER (a) AS e0, var_samp(v) FILTER (NOT a) / count(*) FILTER (NOT a) AS e1, count(*) FILTER (a) AS n0, count(*) FILTER (NOT a) AS n1 FROM x GROUP BY feature),
t AS (SELECT *, (m0 - m1) / sqrt(e0 + e1) AS t, (e0 + e1) ** 2 / (e0 ** 2 / (n0 - 1) + e1 ** 2 / (n1 - 1)) AS k FROM m),
rk AS (SELECT feature, a, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS rk FROM x),
ti AS (SELECT feature, sum(c ** 3 - c) AS ties FROM (SELECT feature, count(*)::DOUBLE AS c FROM x GROUP BY feature, v) GROUP BY feature),
u AS (SELECT feature, sum(rk) FILTER (a) - (count(*) FILTER (a))::DOUBLE * (count(*) FILTER (a) + 1) / 2 AS u FROM rk GROUP BY feature),
z AS (SELECT t.*, u, (greatest(u, n0::DOUBLE * n1 - u) - n0::DOUBLE * n1 / 2 - 0.5) / sqrt(n0::DOUBLE * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1)::DOUBLE * (n0 + n1 - 1)))) AS z FROM t JOIN u USING (feature) JOIN ti USING (feature)),
g AS (SELECT i, CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(20001) s(i)),
p AS (SELECT feature, t, u, z, 1 - 2 * sum(w * exp(lgamma((k + 1) / 2) - lgamma(k / 2)) / sqrt(k * pi()) * (1 + (abs(t) * i / 20000) ** 2 / k) ** (-(k + 1) / 2)) * abs(t) / 60000 AS t_p,
  1 - 2 * sum(w * exp(-((z * i / 20000) ** 2) / 2)) / sqrt(2 * pi()) * z / 60000 AS u_p FROM z, g GROUP BY feature, t, u, z)"""


@register("significance_rank", f"{SIGNIFICANCE}, c AS (SELECT feature, t_p, u_p, t_p * u_p * (1 - ln(t_p * u_p)) AS combined_p FROM p) SELECT feature, round(t_p, 8) AS t_p, round(u_p, 8) AS u_p, round(combined_p, 8) AS combined_p, CAST(count(*) OVER (ORDER BY combined_p) AS BIGINT) AS rank FROM c")
def significance_rank(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", *[F.col(c).alias(k) for k, c in FEATURES.items()])
    found = Z.rank_significance(li, list(FEATURES), "l_returnflag", "R", "A")
    return found.select("feature", *[r(c, 8).alias(c) for c in ("t_p", "u_p", "combined_p")], "rank")


@register(
    "normal_distance",
    f"""WITH x AS ({" UNION ALL ".join(f"SELECT '{k}' AS feature, {c}::DOUBLE AS v FROM lineitem" for k, c in FEATURES.items())}),
m AS (SELECT feature, avg(v) AS m, stddev_samp(v) AS s, count(*) AS n FROM x GROUP BY feature),
c AS (SELECT feature, v, sum(count(*)) OVER (PARTITION BY feature ORDER BY v) AS upto, count(*) AS k FROM x GROUP BY feature, v),
y AS (SELECT feature, n, upto, k, (v - m) / s AS z FROM c JOIN m USING (feature)),
zs AS (SELECT DISTINCT z FROM y), g AS (SELECT i, CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(201) s(i)),
ph AS (SELECT z, 0.5 + sum(w * exp(-((z * i / 200) ** 2) / 2)) / sqrt(2 * pi()) * z / 600 AS phi FROM zs, g GROUP BY z)
SELECT feature, n, round(max(greatest(upto / n - phi, phi - (upto - k) / n)), 6) AS distance FROM y JOIN ph USING (z) GROUP BY feature, n""",
)
def normal_distance(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*[F.col(c).alias(k) for k, c in FEATURES.items()])
    return Z.normal_distance(li, list(FEATURES)).select("feature", "n", r("distance").alias("distance"))


@register(
    "metric_suite",
    f"""WITH {CURVE}, q AS (SELECT sum((p >= 0.5 AND y = 1)::INT) AS tp, sum((p >= 0.5 AND y = 0)::INT) AS fp, sum((p < 0.5 AND y = 1)::INT) AS fn, sum((p < 0.5 AND y = 0)::INT) AS tn FROM d),
a AS (SELECT sum(pos * (n - fp + neg / 2)) / (max(p) * max(n)) AS roc_auc, sum(pos / p * tp / (tp + fp)) AS average_precision FROM c),
s AS (SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, average_precision, roc_auc, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy FROM q, a),
l AS (SELECT *, [accuracy, precision, recall, f1, average_precision, roc_auc, balanced_accuracy] AS v FROM s)
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(average_precision, 6) AS average_precision, round(roc_auc, 6) AS roc_auc, round(balanced_accuracy, 6) AS balanced_accuracy,
 round(list_avg(v), 6) AS mean, round(list_stddev_pop(v), 6) AS sd FROM l""",
)
def metric_suite(spark, sf_dir):
    m = V.metric_suite(scored(spark, sf_dir), "p", "y")
    return m.select(*[r(c).alias(c) for c in m.columns])
