"""Queries over thresholds by name, curves on a grid and tables of folds: the folds are languages, the score is a function of length."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as V
from tidemark.operators import nights as N
from tidemark.operators import results as R
from tidemark.operators import thresholds as T

from .catalogue import register
from .evaluation_queries import CURVE, D, curve, scored
from .feature_queries import bouts
from .series_queries import r

NAMES = ["fixed:0.4", *T.NAMES]


def _menu(rows: str, group: str) -> str:
    """One SELECT of (name, threshold) over ``rows`` (p, y, group), spelled out for each name of NAMES."""
    return f"""WITH d AS ({rows}), k AS (SELECT p AS score, sum((y = 1)::INT) AS pos, sum((y = 0)::INT) AS neg FROM d GROUP BY p),
c AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM k WINDOW w AS (ORDER BY score DESC)),
kg AS (SELECT {group} AS g, p AS score, sum((y = 1)::INT) AS pos, sum((y = 0)::INT) AS neg FROM d GROUP BY ALL),
cg AS (SELECT g, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY g) AS p, sum(neg) OVER (PARTITION BY g) AS n FROM kg WINDOW w AS (PARTITION BY g ORDER BY score DESC)),
ok AS (SELECT * FROM cg WHERE p > 0 AND n > 0),
rd AS (SELECT g, score, sqrt((fp / n) ** 2 + (1 - tp / p) ** 2) AS v FROM ok),
rg AS (SELECT g, CASE WHEN v < 1 THEN score ELSE 0.5 END AS t FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v, score DESC) AS i FROM rd) WHERE i = 1),
pg AS (SELECT g, score AS t FROM (SELECT g, score, row_number() OVER (PARTITION BY g ORDER BY round(sqrt((1 - tp / (tp + fp)) ** 2 + (1 - tp / p) ** 2), 12), score DESC) AS i FROM ok) WHERE i = 1),
fg AS (SELECT g, score AS t FROM (SELECT g, score, row_number() OVER (PARTITION BY g ORDER BY round(2 * tp / (tp + fp + p), 12) DESC, score DESC) AS i FROM ok) WHERE i = 1),
a AS (SELECT score, sqrt((fp / n) ** 2 + (1 - tp / p) ** 2) AS v FROM c WHERE p > 0 AND n > 0),
t AS (SELECT unnest(range(0, 401)) / 400 AS threshold UNION SELECT p FROM d),
gs AS (SELECT {group} AS g, sum((y = 1)::INT) AS p, sum((y = 0)::INT) AS n FROM d GROUP BY ALL HAVING sum((y = 1)::INT) > 0 AND sum((y = 0)::INT) > 0),
m AS (SELECT threshold, avg(ba) AS ba, sum(ba * size ** 2) / sum(size ** 2) AS wa FROM (SELECT threshold, gs.g, any_value(gs.p + gs.n)::DOUBLE AS size, (count(*) FILTER (d.p >= threshold AND y = 1) / any_value(gs.p) + 1 - count(*) FILTER (d.p >= threshold AND y = 0) / any_value(gs.n)) / 2 AS ba FROM t, gs, d WHERE d.{group} = gs.g GROUP BY threshold, gs.g) GROUP BY threshold)
SELECT 'default' AS name, 0.5::DOUBLE AS threshold UNION ALL SELECT 'fixed:0.4', 0.4::DOUBLE
UNION ALL SELECT 'roc_dist', (SELECT CASE WHEN v < 1 THEN score ELSE 0.5 END FROM a ORDER BY v, score DESC LIMIT 1)
UNION ALL SELECT 'pr_f1', (SELECT score FROM c WHERE p > 0 AND n > 0 ORDER BY round(2 * tp / (tp + fp + p), 12) DESC, score DESC LIMIT 1)
UNION ALL SELECT 'macro_ba', (SELECT threshold FROM m ORDER BY round(ba, 9) DESC, threshold LIMIT 1)
UNION ALL SELECT 'macro_ba_weighted', (SELECT threshold FROM m ORDER BY round(wa, 9) DESC, threshold LIMIT 1)
UNION ALL SELECT 'pr_dist', (SELECT score FROM c WHERE p > 0 AND n > 0 ORDER BY round(sqrt((1 - tp / (tp + fp)) ** 2 + (1 - tp / p) ** 2), 12), score DESC LIMIT 1)
UNION ALL SELECT 'roc_dist_per_dataset_mean', (SELECT avg(t) FROM rg) UNION ALL SELECT 'roc_dist_per_dataset_median', (SELECT median(t) FROM rg)
UNION ALL SELECT 'pr_dist_per_dataset_mean', (SELECT avg(t) FROM pg) UNION ALL SELECT 'pr_dist_per_dataset_median', (SELECT median(t) FROM pg)
UNION ALL SELECT 'pr_f1_per_dataset_mean', (SELECT avg(t) FROM fg) UNION ALL SELECT 'pr_f1_per_dataset_median', (SELECT median(t) FROM fg)"""


NIGHTS = "SELECT least(n_chars / 4096.0::DOUBLE, 1.0::DOUBLE) AS p, quality AS y, doc_id % 997 AS who, lang FROM labels JOIN documents USING (doc_id)"
PATIENTS = f"SELECT avg(p) AS p, max(y) AS y, min(lang) AS lang FROM ({NIGHTS}) GROUP BY who"


@register(
    "threshold_menu",
    f"SELECT 'night' AS level, name, round(threshold, 9) AS threshold FROM ({_menu(NIGHTS, 'lang')}) UNION ALL SELECT 'patient', name, round(threshold, 9) FROM ({_menu(PATIENTS, 'lang')})",
)
def threshold_menu(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("who", F.col("doc_id") % 997)
    out = T.threshold_menu(rows, "who", "p", "y", "lang", NAMES)
    return out.select("level", "name", r("threshold", 9).alias("threshold"))


def _grid(x: str, y: str, total: str, value: str) -> str:
    return f"""{CURVE}, pt AS (SELECT {x} AS x, {y} AS y, {total} AS s, p, n FROM c UNION ALL SELECT 0, 0, max({total}), max(p), max(n) FROM c),
g AS (SELECT unnest(range(0, 100)) AS i), le AS (SELECT i, max(x * 1e7 + y) AS k, any_value(s) AS s, any_value(p) AS p, any_value(n) AS n FROM g, pt WHERE x * 99 <= i * s GROUP BY i),
ri AS (SELECT i, min(x * 1e7 + y) AS k FROM g, pt WHERE x * 99 > i * s GROUP BY i),
e AS (SELECT i, s, p, n, floor(le.k / 1e7) AS ax, le.k - floor(le.k / 1e7) * 1e7 AS ay, floor(ri.k / 1e7) AS bx, ri.k - floor(ri.k / 1e7) * 1e7 AS b_y FROM le LEFT JOIN ri USING (i)),
v AS (SELECT i, p, n, (i * s / 99 - ax) / (bx - ax) AS f, {value.replace('X', 'ax').replace('Y', 'ay')} AS a, {value.replace('X', 'bx').replace('Y', 'b_y')} AS b FROM e),
w AS (SELECT i, p, n, CASE WHEN b IS NULL THEN a ELSE a + (b - a) * f END AS v FROM v)"""


ROC = _grid("fp", "tp", "n", "(Y / p)") + ", rocg AS (SELECT CAST(i AS INTEGER) AS i, i / 99 AS fpr, CASE WHEN i = 0 THEN 0 ELSE v END AS tpr FROM w)"
PR = _grid("tp", "fp", "p", "(CASE WHEN X IS NULL THEN NULL WHEN X + Y > 0 THEN X / (X + Y) ELSE 1 END)") + ", prg AS (SELECT CAST(i AS INTEGER) AS i, i / 99 AS recall, CASE WHEN i = 0 THEN 1 WHEN i = 99 THEN p / (p + n) ELSE v END AS precision FROM w)"


@register("roc_on_grid", f"WITH {ROC} SELECT i, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM rocg")
def roc_on_grid(spark, sf_dir):
    return T.roc_on_grid(curve(spark, sf_dir)).select("i", r("fpr").alias("fpr"), r("tpr").alias("tpr"))


@register("pr_on_grid", f"WITH {PR} SELECT i, round(recall, 6) AS recall, round(precision, 6) AS precision FROM prg")
def pr_on_grid(spark, sf_dir):
    return T.pr_on_grid(curve(spark, sf_dir)).select("i", r("recall").alias("recall"), r("precision").alias("precision"))


@register(
    "grid_summary",
    f"SELECT (SELECT round(sum(a), 6) FROM (WITH {ROC} SELECT (tpr + lag(tpr) OVER (ORDER BY i)) / 2 * (fpr - lag(fpr) OVER (ORDER BY i)) AS a FROM rocg)) AS auc, (SELECT round(max(f), 6) FROM (WITH {PR} SELECT 2 * recall * precision / nullif(recall + precision, 0) AS f FROM prg)) AS f1_max",
)
def grid_summary(spark, sf_dir):
    c = curve(spark, sf_dir)
    return T.grid_summary(T.roc_on_grid(c), T.pr_on_grid(c)).select(r("auc").alias("auc"), r("f1_max").alias("f1_max"))


FOLDS = f"""{D}, x AS (SELECT source, lang, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM d GROUP BY source, lang),
f AS (SELECT source, lang, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM x)"""


def folds(spark, sf_dir):
    return V.confusion(scored(spark, sf_dir), "p", "y", keys=["source", "lang"]).select("source", "lang", "accuracy", "f1")


@register("score_summary", f"WITH {FOLDS}, l AS (UNPIVOT f ON accuracy, f1 INTO NAME metric VALUE v) SELECT source, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(*) AS n FROM l GROUP BY source, metric")
def score_summary(spark, sf_dir):
    return R.score_summary(folds(spark, sf_dir), ["accuracy", "f1"], ["source"]).select("source", "metric", r("mean").alias("mean"), r("sd").alias("sd"), "n")


@register("leave_one_out_summary", f"WITH {FOLDS}, e AS (SELECT source, avg(accuracy) AS accuracy, avg(f1) AS f1 FROM f GROUP BY source) SELECT source, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM e UNION ALL SELECT 'all', round(avg(accuracy), 6), round(avg(f1), 6) FROM e")
def leave_one_out_summary(spark, sf_dir):
    s = R.leave_one_out_summary(folds(spark, sf_dir), "source", ["accuracy", "f1"])
    return s.select("source", r("accuracy").alias("accuracy"), r("f1").alias("f1"))


@register("selection_frequency", f"WITH {FOLDS}, t AS (SELECT count(*) AS n FROM f), s AS (SELECT 'accuracy' AS feature, count(*) FILTER (accuracy >= 0.5) AS n FROM f UNION ALL SELECT 'f1', count(*) FILTER (f1 >= 0.5) FROM f) SELECT feature, s.n, round(s.n / t.n, 6) AS share FROM s, t WHERE s.n > 0")
def selection_frequency(spark, sf_dir):
    chosen = F.array_compact(F.array(*[F.when(F.col(m) >= 0.5, F.lit(m)) for m in ("accuracy", "f1")]))
    return R.selection_frequency(folds(spark, sf_dir).withColumn("chosen", chosen), "chosen").select("feature", "n", r("share").alias("share"))


@register("best_folds", f"WITH {FOLDS}, g AS (SELECT source || '/' || lang AS fold, round(f1, 9) AS f1 FROM f) SELECT fold, round(f1, 6) AS f1 FROM g QUALIFY row_number() OVER (ORDER BY f1 DESC, fold) <= greatest(1, ceil(0.1 * (SELECT count(*) FROM g)))")
def best_folds(spark, sf_dir):
    f = folds(spark, sf_dir).select(F.concat_ws("/", "source", "lang").alias("fold"), r("f1", 9).alias("f1"))
    return R.best_folds(f, "f1", "fold", 0.1).select("fold", r("f1").alias("f1"))


@register("kde_peaks")
def kde_peaks(spark, sf_dir):
    return N.kde_peaks(bouts(spark, sf_dir), ["user_id"])
