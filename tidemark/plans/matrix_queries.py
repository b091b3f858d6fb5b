"""The cohort matrix over order lines: a line is a movement, a customer a patient, an order's year a record and its quarter a night."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import matrix as M

from .catalogue import register
from .series_queries import r, table

LOCAL, GLOBAL = ["quantity", "discount"], ["spent"]
ROWS = """o AS (SELECT o_orderkey, o_custkey AS id, 'R' || year(o_orderdate) AS record_id, quarter(o_orderdate) AS night, o_totalprice FROM orders),
l AS (SELECT id || '_' || lower(record_id) AS record_key, night, l_quantity AS quantity, l_discount AS discount, l_quantity AS time_diff FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE l_quantity > 0.5 AND l_quantity < 50),
m AS (SELECT DISTINCT id::VARCHAR AS id, id || '_' || lower(record_id) AS record_key, id % 2 AS ground_truth, CASE WHEN id % 3 = 0 THEN 'test' ELSE 'train' END AS side FROM o WHERE id % 7 <> 3)"""


def _nights() -> str:
    forms = {
        "mean": "avg({f})", "std": "stddev_samp({f})", "skew": "CASE WHEN count(*) > 2 AND stddev_pop({f}) > 0 THEN skewness({f}) END",
        "kurt": "CASE WHEN count(*) > 3 AND stddev_pop({f}) > 0 THEN kurtosis({f}) END", "mad": "avg(abs({f} - m_{f}))", "iqr": "quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)",
        "p10": "quantile_cont({f}, 0.1)", "p90": "quantile_cont({f}, 0.9)",
    }
    cells = ", ".join(f"{form.replace('{f}', f)} AS {f}_{a}" for a, form in forms.items() for f in LOCAL)
    return f"""{ROWS}, c AS (SELECT *, avg(quantity) OVER w AS m_quantity, avg(discount) OVER w AS m_discount FROM l WINDOW w AS (PARTITION BY record_key, night)),
n AS (SELECT record_key, night, {cells} FROM c GROUP BY record_key, night), g AS (SELECT id || '_' || lower(record_id) AS record_key, night, sum(o_totalprice) AS spent FROM o GROUP BY ALL),
x AS (SELECT m.id, n.record_key, n.night, m.ground_truth, m.side, n.* EXCLUDE (record_key, night), spent FROM n JOIN m ON m.record_key = n.record_key LEFT JOIN g ON g.record_key = n.record_key AND g.night = n.night)"""


#: Added before rounding, as means of hundredths often lie between two roundings.
OFF = "1e-10"
NAMES = [f"{f}_{a}" for a in M.AGGREGATES for f in LOCAL] + GLOBAL


def matrix(spark, sf_dir, level):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("id"), F.concat(F.lit("R"), F.year("o_orderdate")).alias("record_id"), F.quarter("o_orderdate").alias("night"), "o_totalprice"
    )
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("time_diff"))
    local = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    global_ = o.groupBy("id", "record_id", "night").agg(F.sum("o_totalprice").alias("spent"))
    who = F.col("id").cast("long")
    about = o.where(who % 7 != 3).select("id", "record_id", (who % 2).alias("ground_truth"), F.when(who % 3 == 0, "test").otherwise("train").alias("side")).distinct()
    return M.cohort_matrix(local, global_, about, level, LOCAL, GLOBAL)


@register("matrix_moves", f"WITH {ROWS} SELECT m.id, record_key, CAST(night AS INTEGER) AS night, CAST(ground_truth AS INTEGER) AS ground_truth, side, quantity, discount FROM l JOIN m USING (record_key)")
def matrix_moves(spark, sf_dir):
    return matrix(spark, sf_dir, "move")


@register("matrix_nights", f"WITH {_nights()} SELECT id, record_key, CAST(night AS INTEGER) AS night, CAST(ground_truth AS INTEGER) AS ground_truth, side, {', '.join(f'round({n} + {OFF}, 6) AS {n}' for n in NAMES)} FROM x")
def matrix_nights(spark, sf_dir):
    m = matrix(spark, sf_dir, "night")
    return m.select("id", "record_key", "night", "ground_truth", "side", *[r(F.col(n) + float(OFF)).alias(n) for n in NAMES])


@register("matrix_patients", f"WITH {_nights()} SELECT id, min(record_key) AS record_key, CAST(min(ground_truth) AS INTEGER) AS ground_truth, min(side) AS side, {', '.join(f'round(avg({n}) + {OFF}, 6) AS {n}' for n in NAMES)} FROM x GROUP BY id")
def matrix_patients(spark, sf_dir):
    m = matrix(spark, sf_dir, "patient")
    return m.select("id", "record_key", "ground_truth", "side", *[r(F.col(n) + float(OFF)).alias(n) for n in NAMES])
