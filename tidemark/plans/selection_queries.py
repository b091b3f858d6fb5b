"""Queries over cohort matrices: validation, selection, calendar, metadata, merging and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.operators import selection as X

from .catalogue import register
from .evaluation_queries import D, scored
from .series_queries import r, table


@register("missing_counts", "SELECT count(*) AS rows, count(*) FILTER (text = '' OR lang IS NULL OR lang = 'fr') AS incomplete, round(count(*) FILTER (text = '' OR lang IS NULL OR lang = 'fr') / count(*), 6) AS share FROM documents WHERE text IS NOT NULL")
def missing_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    odd = d.select(F.when(F.col("text") == "", F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("a"), F.when(F.col("lang") != "fr", F.col("lang")).alias("b"))
    return X.missing_counts(odd, ["a", "b"]).select("rows", "incomplete", r("share").alias("share"))


@register("duration_filter", "SELECT event_id, value FROM events WHERE value > 0.5 AND value < 50")
def duration_filter(spark, sf_dir):
    return X.keep_durations(table(spark, sf_dir, "events").select("event_id", "value"), "value")


@register("calendar_parts", "SELECT event_id, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute FROM events")
def calendar_parts(spark, sf_dir):
    return X.calendar_parts(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").drop("ts")


@register("duration_seconds", "SELECT user_id, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) AS duration_sec FROM events GROUP BY user_id")
def duration_seconds(spark, sf_dir):
    d = X.duration_seconds(table(spark, sf_dir, "events").select("user_id", micros("ts").alias("us")), "user_id", "us")
    return d.select("user_id", r("duration_sec").alias("duration_sec"))


@register("select_features", "SELECT l_orderkey, l_linenumber, l_tax, l_quantity FROM lineitem")
def select_features(spark, sf_dir):
    return X.select_features(table(spark, sf_dir, "lineitem"), ["l_tax", "l_quantity", "l_tax"], ["l_orderkey", "l_linenumber"])


@register("select_samples", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def select_samples(spark, sf_dir):
    d, wanted = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("toxic = 1")
    return X.select_samples(d, wanted.union(wanted), ["doc_id"])


@register("strat_labels", f"WITH {D} SELECT concat(lang, '_', y) AS strat, count(*) AS n FROM d GROUP BY 1")
def strat_labels(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(X.strat_label("y", "lang").alias("strat")).agg(F.count(F.lit(1)).alias("n"))


@register("merge_sets", "SELECT c_custkey AS id, c_acctbal AS bal, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 's' FROM supplier")
def merge_sets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.lit("c").alias("kind"))
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id"))
    return X.merge_sets(c, s)


@register("split_sets", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def split_sets(spark, sf_dir):
    parts = X.split_sets(table(spark, sf_dir, "documents").select("lang"), "lang")
    counted = [p.groupBy("lang").agg(F.count(F.lit(1)).alias("n")) for p in parts.values()]
    return X.merge_sets(*counted)


@register(
    "split_problems",
    """WITH s AS (SELECT l_orderkey % 7 AS split, l_partkey % 40 - 2 AS i, CASE WHEN l_orderkey % 7 = 3 OR l_linenumber % 3 > 0 THEN 'train' ELSE 'test' END AS role FROM lineitem)
SELECT split, 'repeated' AS problem, count(*) AS n FROM (SELECT split, role, i FROM s GROUP BY ALL HAVING count(*) > 1) GROUP BY split
UNION ALL SELECT split, 'outside', count(*) FROM s WHERE i < 0 OR i >= 35 GROUP BY split
UNION ALL SELECT split, 'in_both', count(*) FROM (SELECT split, i FROM s GROUP BY ALL HAVING count(DISTINCT role) > 1) GROUP BY split
UNION ALL SELECT split, 'lacks_a_role', 1 FROM s GROUP BY split HAVING count(DISTINCT role) < 2""",
)
def split_problems(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    train = (F.col("l_orderkey") % 7 == 3) | (F.col("l_linenumber") % 3 > 0)
    s = li.select((F.col("l_orderkey") % 7).alias("split"), (F.col("l_partkey") % 40 - 2).alias("i"), F.when(train, "train").otherwise("test").alias("role"))
    return X.split_problems(s, "i", "split", "role", 35)


@register(
    "night_metadata",
    """WITH b AS (SELECT o_custkey AS id, l_linenumber AS night, min(c_mktsegment) AS segment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_linenumber < 5 GROUP BY ALL),
f AS (SELECT o_custkey AS id, l_linenumber AS night, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT f.id, f.night, n, segment FROM f LEFT JOIN b ON f.id = b.id AND f.night = b.night""",
)
def night_metadata(spark, sf_dir):
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    bouts = j.select(F.col("o_custkey").alias("id"), F.col("l_linenumber").alias("night"), F.col("c_mktsegment").alias("segment"))
    features = bouts.groupBy("id", "night").agg(F.count(F.lit(1)).alias("n"))
    return X.attach_night_metadata(features, bouts.where("night < 5"), ["id", "night"], ["segment"])


@register("set_operations", "SELECT 'both' AS kind, c_nationkey AS k FROM (SELECT c_nationkey FROM customer WHERE c_nationkey < 15 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 9)")
def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    both = c.where("c_nationkey < 15").intersect(s).select(F.lit("both").alias("kind"), F.col("c_nationkey").alias("k"))
    return both.unionByName(c.subtract(s.where("s_nationkey > 9")).select(F.col("c_nationkey").alias("k"), F.lit("only").alias("kind")))
