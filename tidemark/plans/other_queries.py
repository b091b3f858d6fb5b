"""Queries over decoders, kernels, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F


from tidemark.operators import kernels as K
from tidemark.operators import learning as L
from tidemark.operators import process as P
from tidemark.sources import devices as S
from tidemark.sources import tables as T
from tidemark.streaming import windows as ST

from .catalogue import register
from .evaluation_queries import scored
from .series_queries import BOUTS, HIT, micros, table


@register(
    "hex_decode",
    "WITH h AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 37 + l_linenumber * 101) % 4096 AS v FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN v >= 2048 THEN v - 4096 ELSE v END AS INTEGER) AS value FROM h",
)
def hex_decode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lpad(F.hex((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101) % 4096), 3, "0").alias("h"))
    return li.select("l_orderkey", "l_linenumber", S.twelve_bits(F.col("h")).alias("value"))


@register("packed_timestamp", "SELECT o_orderkey, epoch_us(date_trunc('second', o_orderdate)) AS us FROM orders WHERE year(o_orderdate) BETWEEN 2000 AND 2063 UNION ALL SELECT o_orderkey, epoch_us(date_trunc('second', o_orderdate) + INTERVAL 10 YEAR) FROM orders WHERE year(o_orderdate) < 2000 AND NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)")
def packed_timestamp(spark, sf_dir):
    d = F.col("o_orderdate")
    o = table(spark, sf_dir, "orders").where("year(o_orderdate) >= 2000 or not (month(o_orderdate) = 2 and day(o_orderdate) = 29)")
    year = F.year(d) + F.when(F.year(d) < 2000, 10).otherwise(0) - 2000
    packed = F.lit(0).cast("long")
    for value, at in ((year, 26), (F.month(d), 22), (F.dayofmonth(d), 17), (F.hour(d), 12), (F.minute(d), 6), (F.second(d), 0)):
        packed = packed + value.cast("long") * (1 << at)
    return o.select("o_orderkey", micros(S.unpack_time(packed)).alias("us"))


@register("signal_kernels")
def signal_kernels(spark, sf_dir):
    return K.bout_features(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 32.0)


@register("butter_zero_phase")
def butter_zero_phase(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    rows = v.select("vec_id", (F.col("i") * 31250).cast("long").alias("us"), F.col("v").cast("double").alias("v"))
    return K.butterworth_filter(rows, "vec_id", "us", ["v"], 32.0, high=8.0)


@register("sphere_calibration")
def sphere_calibration(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    wide = v.groupBy("vec_id", F.floor(F.col("i") / 3).alias("k")).agg(*[F.max(F.when(F.col("i") % 3 == j, F.col("v"))).alias(a) for j, a in enumerate("xyz")]).dropna()
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    base = wide.where(n > 0).select((F.col("vec_id") % 5).alias("recording_id"), (F.col("vec_id") * 1000 + F.col("k")).alias("w"), *[(F.col(a) / n * 1.02 + 0.01).alias(a) for a in "xyz"])
    still = base.withColumn("o", F.explode(F.array(F.lit(0), F.lit(5_000_000)))).select("recording_id", (F.col("w") * 10_000_000 + F.col("o")).alias("us"), "x", "y", "z")
    return P.calibration(still)


@register("info_json", "SELECT CAST(to_json(t) AS VARCHAR) AS info FROM customer t")
def info_json(spark, sf_dir):
    return T.info_json(table(spark, sf_dir, "customer"))


@register("patient_predictions", """WITH d AS (SELECT source AS id, l.doc_id AS night, least(n_chars / 4096.0::DOUBLE, 1.0::DOUBLE) AS prob FROM labels l JOIN documents USING (doc_id))
SELECT id, count(*) AS n_nights, string_agg(printf('%.4f', prob), ',' ORDER BY night) AS nightly_probs FROM d GROUP BY id""")
def patient_predictions(spark, sf_dir):
    d = scored(spark, sf_dir).select(F.col("source").alias("id"), F.col("doc_id").alias("night"), F.col("p").alias("prob"))
    return T.patient_predictions(d)


def _rows(spark, sf_dir):
    d = scored(spark, sf_dir)
    x = [((F.col("doc_id") * k) % 101 / 101).alias(f"x{k}") for k in (7, 13)]
    return d.select("doc_id", "source", (F.col("doc_id") % 3).alias("fold"), (F.floor(F.col("doc_id") / 3) % 2).alias("inner"), F.col("y").cast("double").alias("y"), "p", *x)


@register("model_cross_validation")
def model_cross_validation(spark, sf_dir):
    return L.cross_validate(_rows(spark, sf_dir), "fold", "lr", ["p", "x7", "x13"], "y", {"regParam": 0.01})


@register("model_predict")
def model_predict(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    model = L.pipeline("rf", ["p", "x7"], "y", numTrees=20, seed=1).fit(rows.where("fold > 0"))
    return L.predict(rows, model, ["p", "x7"], "source", "doc_id")


@register("probability_calibration")
def probability_calibration(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return L.calibrate(rows.where("fold > 0"), "p", "y", "isotonic")(rows).select("doc_id", "p", "calibrated")


@register("stream_sessions", f"WITH {BOUTS} SELECT user_id, start_us, end_us, n FROM b")
def stream_sessions(spark, sf_dir):
    """Sessions over the events as a stream; a session window closes at its last row plus the gap."""
    rows = ST.read_table_stream(spark, f"{sf_dir}/events.parquet", "ts").where(F.col("value") > HIT)
    found = ST.run_to_table(ST.sessions(rows, "user_id", "ts", f"{6 * 3600} seconds"), "stream")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


