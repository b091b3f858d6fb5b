"""Queries over scalers, rankings and cohort tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import DAY, HOUR, micros
from tidemark.operators import cohort as C
from tidemark.operators import ranking as R

from .catalogue import register
from .evaluation_queries import D, scored
from .series_queries import r, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = "l_orderkey, l_linenumber"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", *NUM, (F.col("l_returnflag") == "R").cast("int").alias("y"))


def _scaler(name: str, centre: str, spread: str):
    q = ", ".join(f"{centre.format(f)} AS {f}_c, CASE WHEN {spread.format(f)} > 1e-8 THEN {spread.format(f)} ELSE 1 END AS {f}_s" for f in NUM)
    out = ", ".join(f"round((l.{f} - {f}_c) / {f}_s, 6) AS {f}" for f in NUM)
    sql = f"WITH q AS (SELECT {q} FROM lineitem) SELECT {KEY}, {out} FROM lineitem l, q"

    @register(f"scaler_{name}", sql)
    def query(spark, sf_dir):
        li = lines(spark, sf_dir)
        s = R.apply_scale(li, R.scale_parameters(li, NUM, name), NUM)
        return s.select("l_orderkey", "l_linenumber", *[r(f).alias(f) for f in NUM])

    return query


_scaler("standard", "avg({0})", "stddev_pop({0})")
_scaler("minmax", "min({0})", "(max({0}) - min({0}))")
_scaler("robust", "quantile_cont({0}, 0.5)", "(quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25))")

_q = ", ".join(f"avg({f}) AS {f}_c, CASE WHEN stddev_pop({f}) > 1e-8 THEN stddev_pop({f}) ELSE 1 END AS {f}_s" for f in NUM)
_m = ", ".join(f"avg({f}_{p}) AS m_{f}_{p}" for f in NUM for p in "cs")
_o = ", ".join(f"round((l.{f} - coalesce({f}_c, m_{f}_c)) / coalesce({f}_s, m_{f}_s), 6) AS {f}" for f in NUM)


@register(
    "scaler_macro",
    f"WITH q AS (SELECT l_returnflag, {_q} FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_returnflag), m AS (SELECT {_m} FROM q) SELECT {KEY}, {_o} FROM lineitem l LEFT JOIN q ON q.l_returnflag = l.l_returnflag, m",
)
def scaler_macro(spark, sf_dir):
    li = lines(spark, sf_dir)
    params = R.scale_parameters(li.where("l_returnflag <> 'A'"), NUM, "standard", ["l_returnflag"])
    return R.apply_scale(li, params, NUM, ["l_returnflag"]).select("l_orderkey", "l_linenumber", *[r(f).alias(f) for f in NUM])


LONG = "x AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v, (l_returnflag = 'R')::INT AS y FROM lineitem" for f in NUM) + ")"
CORR = f"""{LONG}, k AS (SELECT feature, v, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS rk FROM x),
g AS (SELECT feature, v, sum(y) AS pos, count(*) - sum(y) AS neg, count(*) AS n FROM x GROUP BY feature, v),
h AS (SELECT *, coalesce(sum(neg) OVER w, 0) AS bn, coalesce(sum(pos) OVER w, 0) AS bp FROM g WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT feature, sum(pos * bn - neg * bp) AS con, sum(n * (n - 1) / 2) AS ties, sum(n) AS n, sum(pos) AS p FROM h GROUP BY feature),
kt AS (SELECT feature, con / sqrt((n * (n - 1) / 2 - ties) * (n * (n - 1) / 2 - p * (p - 1) / 2 - (n - p) * (n - p - 1) / 2)) AS kendall FROM t),
cc AS (SELECT feature, corr(v, y) AS pearson, corr(rk, y) AS spearman FROM k GROUP BY feature)"""


@register("rank_label_corr", f"WITH {CORR} SELECT feature, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(kendall, 6) AS kendall FROM cc JOIN kt USING (feature)")
def rank_label_corr(spark, sf_dir):
    c = R.label_correlations(lines(spark, sf_dir), NUM, "y")
    return c.select("feature", *[r(x).alias(x) for x in ("pearson", "spearman", "kendall")])


@register("rank_spearman", "WITH k AS (SELECT l_quantity AS v, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rk FROM lineitem) SELECT v AS value, any_value(rk) AS rank, count(*) AS n FROM k GROUP BY v")
def rank_spearman(spark, sf_dir):
    return R.average_ranks(lines(spark, sf_dir), "l_quantity")


RED = ", ".join(f"abs(corr({a}, {b})) AS c{i}{j}" for i, a in enumerate(NUM) for j, b in enumerate(NUM) if i < j)


@register(
    "rank_redundancy",
    f"WITH c AS (SELECT {RED} FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(({' + '.join(f'c{min(i, j)}{max(i, j)}' for j in range(len(NUM)) if j != i)}) / {len(NUM) - 1}, 6) AS redundancy FROM c" for i, f in enumerate(NUM)
    ),
)
def rank_redundancy(spark, sf_dir):
    return R.redundancy(lines(spark, sf_dir), NUM).select("feature", r("redundancy").alias("redundancy"))


VAR = f"{LONG}, sv AS (SELECT feature, var_pop(v) / (max(v) - min(v)) ** 2 AS variance, (quantile_cont(v, 0.5) - min(v)) / (max(v) - min(v)) AS median FROM x GROUP BY feature)"


@register("rank_variance", f"WITH {VAR} SELECT feature, round(variance, 6) AS variance, round(median, 6) AS median, rank() OVER (ORDER BY -round(variance, 9)) AS rank FROM sv")
def rank_variance(spark, sf_dir):
    v = R.ranked(R.scaled_variance(lines(spark, sf_dir), NUM), -F.round("variance", 9))
    return v.select("feature", r("variance").alias("variance"), r("median").alias("median"), "rank")


_RANKS = f"""{CORR}, sv AS (SELECT feature, var_pop(v) / (max(v) - min(v)) ** 2 AS variance FROM x GROUP BY feature),
rs AS (SELECT feature, 'pearson' AS method, rank() OVER (ORDER BY -round(abs(pearson), 9)) AS rank FROM cc UNION ALL SELECT feature, 'spearman', rank() OVER (ORDER BY -round(abs(spearman), 9)) FROM cc
 UNION ALL SELECT feature, 'variance', rank() OVER (ORDER BY -round(variance, 9)) FROM sv)"""
WEIGHTS = {"pearson": 1.0, "spearman": 1.0, "variance": 0.2}


def _ranks(spark, sf_dir):
    li = lines(spark, sf_dir)
    corr = R.label_correlations(li, NUM, "y")
    one = lambda df, name, v: R.ranked(df, v).select("feature", F.lit(name).alias("method"), "rank")
    pear, spear = (one(corr, n, -F.round(F.abs(F.col(n)), 9)) for n in ("pearson", "spearman"))
    return pear.union(spear).union(one(R.scaled_variance(li, NUM), "variance", -F.round("variance", 9)))


@register(
    "rank_fusion",
    f"WITH {_RANKS}, f AS (SELECT feature, sum(w * rank) / sum(w) AS fused FROM (SELECT *, CASE method WHEN 'variance' THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS w FROM rs) GROUP BY feature) SELECT feature, round(fused, 6) AS fused, count(*) OVER (ORDER BY round(fused, 9)) AS rank FROM f",
)
def rank_fusion(spark, sf_dir):
    return R.fuse(_ranks(spark, sf_dir), WEIGHTS).select("feature", r("fused").alias("fused"), "rank")


@register("rank_borda", f"WITH {_RANKS}, f AS (SELECT feature, sum({len(NUM)} - rank) AS points FROM rs GROUP BY feature) SELECT feature, CAST(points AS BIGINT) AS points, count(*) OVER (ORDER BY points DESC) AS rank FROM f")
def rank_borda(spark, sf_dir):
    return R.borda(_ranks(spark, sf_dir))


@register("f_statistics", f"""WITH {LONG}, g AS (SELECT feature, y, count(*) AS n, avg(v) AS m, var_pop(v) AS vv FROM x GROUP BY feature, y), t AS (SELECT feature, sum(n * m) / sum(n) AS gm, sum(n) AS total FROM g GROUP BY feature)
SELECT feature, round(sum(n * (m - gm) ** 2) / (sum(n * vv) / (any_value(total) - 2)), 5) AS f FROM g JOIN t USING (feature) GROUP BY feature""")
def f_statistics(spark, sf_dir):
    return R.f_statistics(lines(spark, sf_dir), NUM, "y").select("feature", r("f", 5).alias("f"))


@register("mrmr_features")
def mrmr_features(spark, sf_dir):
    chosen = R.mrmr(lines(spark, sf_dir), NUM, "y", 3)
    return spark.createDataFrame(list(enumerate(chosen)), "place int, feature string")


@register(
    "welch_t_stat",
    """WITH s AS (SELECT avg(value) FILTER (event_type = 'click') AS m0, var_samp(value) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'click') AS e0, count(*) FILTER (event_type = 'click') AS n0,
 avg(value) FILTER (event_type = 'purchase') AS m1, var_samp(value) FILTER (event_type = 'purchase') / count(*) FILTER (event_type = 'purchase') AS e1, count(*) FILTER (event_type = 'purchase') AS n1 FROM events)
SELECT round((m0 - m1) / sqrt(e0 + e1), 6) AS t, round((e0 + e1) ** 2 / (e0 ** 2 / (n0 - 1) + e1 ** 2 / (n1 - 1)), 4) AS dof FROM s""",
)
def welch_t_stat(spark, sf_dir):
    return R.welch_t(table(spark, sf_dir, "events"), "value", "event_type", "click", "purchase").select(r("t").alias("t"), r("dof", 4).alias("dof"))


@register(
    "mann_whitney_u",
    """WITH e AS (SELECT event_type = 'click' AS a, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk FROM events WHERE event_type IN ('click', 'purchase'))
SELECT sum(rk) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2 AS u, count(*) FILTER (a) AS n0, count(*) FILTER (NOT a) AS n1 FROM e""",
)
def mann_whitney_u(spark, sf_dir):
    return R.mann_whitney_u(table(spark, sf_dir, "events"), "value", "event_type", "click", "purchase")


@register("dataset_weights_dsw", f"WITH {D}, g AS (SELECT source, count(*) AS n FROM d GROUP BY source) SELECT source, n, round((SELECT sum(n) FROM g) / ((SELECT count(*) FROM g) * n), 6) AS weight FROM g")
def dataset_weights_dsw(spark, sf_dir):
    return C.dataset_weights(scored(spark, sf_dir), "source").withColumn("weight", r("weight"))


@register("dataset_weights_dswc", f"WITH {D}, g AS (SELECT lang, y, count(*) AS n FROM d GROUP BY lang, y) SELECT lang, y, n, round((SELECT sum(n) FROM g) / ((SELECT count(*) FROM g) * n), 6) AS weight FROM g")
def dataset_weights_dswc(spark, sf_dir):
    return C.dataset_weights(scored(spark, sf_dir), "lang", "y").withColumn("weight", r("weight"))


@register(
    "rebalance_cap",
    f"WITH {D}, s AS (SELECT lang, count(*) AS n FROM d GROUP BY lang), t AS (SELECT coalesce((SELECT n FROM s ORDER BY n DESC LIMIT 1 OFFSET 1), max(n)) AS t FROM s) SELECT lang, least(n, t) AS n FROM s, t",
)
def rebalance_cap(spark, sf_dir):
    kept = C.rebalance(scored(spark, sf_dir), "lang", "doc_id", "cap_to_second_largest")
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("rebalance_median_ratio", f"""WITH {D}, s AS (SELECT lang, count(*) AS n FROM d GROUP BY lang), t AS (SELECT floor(quantile_cont(n, 0.5)) AS t FROM s), c AS (SELECT lang, y, count(*) AS c FROM d GROUP BY lang, y)
SELECT lang, y, CAST(least(c, greatest(floor(c * least(1.0::DOUBLE, t / n)), 1)) AS BIGINT) AS n FROM c JOIN s USING (lang), t""")
def rebalance_median_ratio(spark, sf_dir):
    kept = C.rebalance(scored(spark, sf_dir), "lang", "doc_id", "median", "y")
    return kept.groupBy("lang", "y").agg(F.count(F.lit(1)).alias("n"))


@register("label_harmonise", "SELECT c_mktsegment, CASE lower(trim(c_mktsegment)) WHEN 'building' THEN 'case' WHEN 'machinery' THEN 'case' ELSE 'control' END AS label, count(*) AS n FROM customer WHERE lower(trim(c_mktsegment)) IN ('building', 'machinery', 'automobile', 'household') GROUP BY 1, 2")
def label_harmonise(spark, sf_dir):
    m = spark.createDataFrame([("Building", "case"), (" machinery ", "case"), ("AUTOMOBILE", "control"), ("household", "control")], "code string, label string")
    rows, _ = C.map_labels(table(spark, sf_dir, "customer"), "c_mktsegment", m)
    return rows.groupBy("c_mktsegment", "label").agg(F.count(F.lit(1)).alias("n"))


@register("record_key", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR ELSE o_custkey || '_' || lower(o_orderstatus) END AS record_key FROM orders")
def record_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("record", F.when(F.col("o_orderstatus") == "F", F.lit(" NaN ")).otherwise(F.col("o_orderstatus")))
    return o.select("o_orderkey", C.record_key("o_custkey", "record").alias("record_key"))


@register("reconcile_missing_extra", "SELECT coalesce(c.k, o.k) AS k, CASE WHEN o.k IS NULL THEN 'missing' WHEN c.k IS NULL THEN 'extra' ELSE 'both' END AS status FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 150000) o ON c.k = o.k")
def reconcile_missing_extra(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("k"))
    return C.reconcile(c, o, "k")


@register("exclude_canonical", "SELECT raw, CASE WHEN lower(trim(raw)) IN ('1', '1.0', 'true', 'yes') THEN '1' WHEN trim(raw) = '?' THEN '?' ELSE '0' END AS flag FROM (VALUES ('1'), (' 1.0'), ('TRUE'), ('yes '), ('?'), ('no'), (''), (NULL), ('0')) t(raw)")
def exclude_canonical(spark, sf_dir):
    rows = [("1",), (" 1.0",), ("TRUE",), ("yes ",), ("?",), ("no",), ("",), (None,), ("0",)]
    return spark.createDataFrame(rows, "raw string").select("raw", C.exclude_flag("raw").alias("flag"))


@register(
    "summary_row_filter",
    "SELECT n_nationkey, n_name FROM nation WHERE NOT regexp_matches(n_name, '(?i)(^|[^a-z])(total|subtotal|sum|gesamt|summe|note|notes|mean|average)([^a-z]|$)')",
)
def summary_row_filter(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    total = n.agg(F.lit(-1).alias("n_nationkey"), F.lit("Total").alias("n_name"), F.sum("n_regionkey").cast("int").alias("n_regionkey"))
    return C.drop_summary_rows(n.union(total), ["n_name"], ["n_regionkey"]).select("n_nationkey", "n_name")


@register("problem_value_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax <> 0 AND l_discount <> 0")
def problem_value_filter(spark, sf_dir):
    li = lines(spark, sf_dir)
    bad = li.withColumn("a", F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))).withColumn("b", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_discount")))
    return bad.where(C.finite(["a", "b"])).select("l_orderkey", "l_linenumber")


@register(
    "record_id_autofill",
    """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'rec1' END AS rec FROM orders), f AS (SELECT DISTINCT o_custkey FROM o WHERE rec IS NOT NULL), n AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY o_custkey),
m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM o WHERE rec IS NULL)
SELECT m.o_orderkey, CASE WHEN n.n = 1 THEN NULL ELSE 'rec' || (i + CASE WHEN f.o_custkey IS NULL THEN 0 ELSE 1 END) END AS rec FROM m JOIN n USING (o_custkey) LEFT JOIN f USING (o_custkey)
UNION ALL SELECT o_orderkey, rec FROM o WHERE rec IS NOT NULL""",
)
def record_id_autofill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("rec1")).alias("rec"))
    return C.fill_record_ids(o, "o_custkey", "rec", "o_orderkey").select("o_orderkey", "rec")


@register("min_nights_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12)")
def min_nights_filter(spark, sf_dir):
    return C.min_nights(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 12)


@register("duplicate_keys", "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return C.duplicates(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@register("lodo_folds", f"WITH {D}, s AS (SELECT DISTINCT source AS subject, lang FROM d), f AS (SELECT DISTINCT lang AS fold FROM d) SELECT subject, fold, CASE WHEN lang = fold THEN 'test' ELSE 'train' END AS role FROM s, f")
def lodo_folds(spark, sf_dir):
    return C.leave_one_out_folds(scored(spark, sf_dir).withColumnRenamed("source", "subject"), "subject", "lang")


FOLDS = "fd AS (SELECT c_custkey AS subject_id, 1 AS repeat, o AS outer_fold, i AS inner_fold, CASE WHEN c_custkey % 3 = o THEN 'test' WHEN c_custkey % 2 = i THEN 'validation' WHEN c_custkey % 50 = 0 THEN 'odd' ELSE 'train' END AS role FROM customer, (SELECT unnest(range(0, 3)) AS o), (SELECT unnest(range(0, 2)) AS i))"


@register("fold_validation", f"WITH {FOLDS} SELECT 'role' AS problem, count(*) AS n FROM fd WHERE role NOT IN ('train', 'validation', 'test') HAVING count(*) > 0")
def fold_validation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), F.lit(1).alias("repeat"), F.explode(F.array(*map(F.lit, range(3)))).alias("outer_fold"))
    c = c.withColumn("inner_fold", F.explode(F.array(F.lit(0), F.lit(1))))
    k = F.col("subject_id")
    role = F.when(k % 3 == F.col("outer_fold"), "test").when(k % 2 == F.col("inner_fold"), "validation").when(k % 50 == 0, "odd").otherwise("train")
    return C.check_folds(c.withColumn("role", role))


@register("group_folds")
def group_folds(spark, sf_dir):
    return C.group_folds(scored(spark, sf_dir), "source", "y", 5)


@register("smote_synthetic")
def smote_synthetic(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("q", F.col("doc_id") % 97)
    return C.smote(d, "doc_id", "y", ["p", "q"])


@register("rollup_label_summary", f"WITH {D} SELECT lang, y, count(*) AS n, count(DISTINCT source) AS subjects FROM d GROUP BY ROLLUP (lang, y)")
def rollup_label_summary(spark, sf_dir):
    return C.label_summary(scored(spark, sf_dir), "lang", "y", "source")


@register(
    "wide_to_long_diary",
    f"""WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) // {DAY} * {DAY} AS day, (o_orderkey % 12) * {HOUR} AS sl, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 9) * {HOUR} END AS wk FROM orders)
SELECT o_orderkey, 'sleep' AS event, day + sl + CASE WHEN sl < {6 * HOUR} THEN {DAY} ELSE 0 END AS us FROM o UNION ALL SELECT o_orderkey, 'wake', day + wk FROM o WHERE wk IS NOT NULL""",
)
def wide_to_long_diary(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.floor(micros("o_orderdate") / DAY) * DAY).alias("day"), (k % 12 * HOUR).alias("sl"), F.when(k % 5 > 0, k % 9 * HOUR).alias("wk")
    )
    return C.diary_rows(o, ["o_orderkey"], {"sleep": "sl", "wake": "wk"}, "day")
