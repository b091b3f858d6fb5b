"""Queries over labelled documents: the score is a function of length, the label is quality, the group is the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as V

from .catalogue import register
from .series_queries import r, table

D = "d AS (SELECT l.doc_id, source, lang, quality AS y, least(n_chars / 4096.0::DOUBLE, 1.0::DOUBLE) AS p FROM labels l JOIN documents USING (doc_id))"
CURVE = f"""{D}, k AS (SELECT p AS score, sum((y = 1)::INT) AS pos, sum((y = 0)::INT) AS neg FROM d GROUP BY p),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM k)"""


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    p = F.least(F.col("n_chars") / 4096, F.lit(1.0))
    return labels.join(docs, "doc_id").select("doc_id", "source", "lang", "y", p.alias("p"))


def curve(spark, sf_dir):
    return V.curve(scored(spark, sf_dir), "p", "y")


@register("roc_curve", f"WITH {CURVE} SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM c")
def roc_curve(spark, sf_dir):
    return curve(spark, sf_dir).select("score", "tp", "fp")


@register("roc_auc_rank", f"WITH {D}, rk AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM d) SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS roc_auc FROM rk")
def roc_auc_rank(spark, sf_dir):
    return V.roc_auc(curve(spark, sf_dir)).select(r("roc_auc").alias("roc_auc"))


@register("average_precision", f"WITH {CURVE} SELECT round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return V.average_precision(curve(spark, sf_dir)).select(r("average_precision").alias("average_precision"))


@register(
    "roc_operating_point",
    f"WITH {CURVE}, t AS (SELECT score, sqrt((fp / n) ** 2 + (1 - tp / p) ** 2) AS d FROM c), b AS (SELECT * FROM t ORDER BY d, score DESC LIMIT 1) SELECT CASE WHEN d < 1 THEN score ELSE 0.5 END AS threshold, round(least(d, 1), 6) AS distance FROM b",
)
def roc_operating_point(spark, sf_dir):
    return V.roc_operating_point(curve(spark, sf_dir)).select("threshold", r("distance").alias("distance"))


@register(
    "pr_operating_points",
    f"""WITH {CURVE}, t AS (SELECT score, round(sqrt((1 - tp / (tp + fp)) ** 2 + (1 - tp / p) ** 2), 12) AS d, round(2 * tp / (tp + fp + p), 12) AS f1 FROM c)
SELECT (SELECT score FROM t ORDER BY d, score DESC LIMIT 1) AS dist_threshold, (SELECT score FROM t ORDER BY f1 DESC, score DESC LIMIT 1) AS f1_threshold, round((SELECT max(f1) FROM t), 6) AS f1""",
)
def pr_operating_points(spark, sf_dir):
    return V.pr_operating_points(curve(spark, sf_dir)).select("dist_threshold", "f1_threshold", r("f1").alias("f1"))


MACRO = f"""{D}, g AS (SELECT lang, sum((y = 1)::INT) AS p, sum((y = 0)::INT) AS n FROM d GROUP BY lang HAVING sum((y = 1)::INT) > 0 AND sum((y = 0)::INT) > 0),
t AS (SELECT DISTINCT t FROM (SELECT unnest(range(0, 401)) / 400 AS t UNION SELECT p FROM d)),
x AS (SELECT t, g.lang, any_value(g.p) AS p, any_value(g.n) AS n, count(*) FILTER (d.y = 1 AND d.p >= t) AS tp, count(*) FILTER (d.y = 0 AND d.p >= t) AS fp FROM t CROSS JOIN g JOIN d ON d.lang = g.lang GROUP BY t, g.lang),
m AS (SELECT t, avg((tp / p + 1 - fp / n) / 2) AS ba FROM x GROUP BY t)"""


@register("macro_ba_candidates", f"WITH {MACRO} SELECT t AS threshold, round(ba, 6) AS macro_ba FROM m")
def macro_ba_candidates(spark, sf_dir):
    return V.macro_balanced_accuracy(scored(spark, sf_dir), "p", "y", "lang").select("threshold", r("macro_ba").alias("macro_ba"))


@register("macro_ba_threshold", f"WITH {MACRO} SELECT t AS threshold, round(ba, 6) AS macro_ba FROM m ORDER BY round(ba, 9) DESC, t LIMIT 1")
def macro_ba_threshold(spark, sf_dir):
    return V.macro_threshold(V.macro_balanced_accuracy(scored(spark, sf_dir), "p", "y", "lang")).select("threshold", r("macro_ba").alias("macro_ba"))


@register(
    "confusion_metrics",
    f"""WITH {D}, c AS (SELECT lang, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM d GROUP BY lang)
SELECT lang, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
 round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS npv, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy FROM c""",
)
def confusion_metrics(spark, sf_dir):
    c = V.confusion(scored(spark, sf_dir), "p", "y", keys=["lang"])
    return c.select("lang", "tp", "fp", "fn", "tn", *[r(x).alias(x) for x in c.columns[5:]])


@register("brier_ece", f"WITH {D}, b AS (SELECT least(greatest(ceil(p * 10), 1), 10) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) ** 2) AS sq FROM d GROUP BY 1) SELECT round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(sp - sy)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def brier_ece(spark, sf_dir):
    return V.brier_ece(scored(spark, sf_dir), "p", "y", 10).select(r("brier").alias("brier"), r("ece").alias("ece"), "n")


@register(
    "calibration_bins",
    f"""WITH {D}, e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM d), b AS (SELECT len(list_filter(e, lambda v: v < p)) AS bin, p, y FROM d, e)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_prob, round(avg(y), 6) AS share FROM b GROUP BY bin""",
)
def calibration_bins(spark, sf_dir):
    return V.calibration_curve(scored(spark, sf_dir), "p", "y", 10).select("bin", "n", r("mean_prob").alias("mean_prob"), r("share").alias("share"))


@register(
    "patient_vote",
    f"""WITH {D}, g AS (SELECT source, avg(p) AS mean_prob, sum(p) AS sum_prob, max(p) AS max_prob, avg((p >= 0.5)::INT) AS mean_pred, sum((p >= 0.5)::INT) AS sum_pred, count(*) AS n_nights, count(DISTINCT y) AS labels, max(y) AS ground_truth FROM d GROUP BY source)
SELECT source, round(mean_prob, 6) AS mean_prob, round(sum_prob, 6) AS sum_prob, max_prob, round(mean_pred, 6) AS mean_pred, CAST(sum_pred AS BIGINT) AS sum_pred, n_nights, labels, ground_truth, mean_prob > 0.5 AS mean_vote, sum_pred >= n_nights / 2 AS majority,
 mean_prob > 0.5 OR sum_pred >= n_nights / 2 AS ensemble_any, mean_prob > 0.5 AND sum_pred >= n_nights / 2 AS ensemble_all FROM g""",
)
def patient_vote(spark, sf_dir):
    v = V.patient_votes(scored(spark, sf_dir), "source", "p", "y")
    return v.withColumns({c: r(c) for c in ("mean_prob", "sum_prob", "mean_pred")})


@register("wrong_nights", f"WITH {D} SELECT source, CAST(sum(((p >= 0.5)::INT <> y)::INT) AS BIGINT) AS wrong FROM d GROUP BY source HAVING sum(((p >= 0.5)::INT <> y)::INT) > 0")
def wrong_nights(spark, sf_dir):
    return V.wrong_nights(scored(spark, sf_dir), "source", "p", "y")


@register("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    return V.bootstrap(scored(spark, sf_dir), "p", "y")


Z = "1.959963984540054"


#: Two-sided 95 % quantiles of Student's t for 1 to 15 degrees of freedom.
T_TABLE = "12.706204736179, 4.302652729750, 3.182446305284, 2.776445105198, 2.570581835636, 2.446911851145, 2.364624251593, 2.306004135204, 2.262157162798, 2.228138851986, 2.200985160092, 2.178812829667, 2.160368656463, 2.144786687918, 2.131449545560"
#: The quantile of k degrees of freedom: from the table, or beyond it by the series in 1 / k.
T = f"(CASE WHEN k <= 15 THEN list_value({T_TABLE})[greatest(k, 1)::INT]::DOUBLE ELSE {Z}e0 + ({Z}e0**3 + {Z}e0) / (4 * k) + (5 * {Z}e0**5 + 16 * {Z}e0**3 + 3 * {Z}e0) / (96 * k**2) + (3 * {Z}e0**7 + 19 * {Z}e0**5 + 17 * {Z}e0**3 - 15 * {Z}e0) / (384 * k**3) + (79 * {Z}e0**9 + 776 * {Z}e0**7 + 1482 * {Z}e0**5 - 1920 * {Z}e0**3 - 945 * {Z}e0) / (92160 * k**4) END)"


@register("mean_ci", f"WITH {D}, g AS (SELECT lang, avg(p) AS m, stddev_samp(p) AS sd, count(p) AS n, (count(p) - 1)::DOUBLE AS k FROM d GROUP BY lang) SELECT lang, round(m, 6) AS mean, round(sd, 6) AS sd, round(m - {T} * sd / sqrt(n), 6) AS lower, round(m + {T} * sd / sqrt(n), 6) AS upper FROM g")
def mean_ci(spark, sf_dir):
    m = V.mean_ci(scored(spark, sf_dir), "p", ["lang"])
    return m.select("lang", *[r(c).alias(c) for c in m.columns[1:]])


@register("pearson_ci", f"WITH {D}, c AS (SELECT lang, CASE WHEN stddev_pop(p) * stddev_pop(y) > 0 THEN corr(p, y) END AS r, count(*) AS n FROM d GROUP BY lang HAVING count(*) > 3) SELECT lang, round(r, 6) AS r, round(tanh(atanh(r) - {Z} / sqrt(n - 3)), 6) AS lower, round(tanh(atanh(r) + {Z} / sqrt(n - 3)), 6) AS upper FROM c")
def pearson_ci(spark, sf_dir):
    return V.pearson_ci(scored(spark, sf_dir), "p", "y", ["lang"]).select("lang", r("r").alias("r"), r("lower").alias("lower"), r("upper").alias("upper"))
