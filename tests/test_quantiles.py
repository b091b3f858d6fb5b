"""Exact quantiles equal ``percentile`` to the last digit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles as Q

SHARES = [0.0, 0.025, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_equal_to_percentile(spark, accuracy):
    rng = np.random.default_rng(1)
    n = 5000
    values = {
        "normal": rng.normal(size=n), "skewed": rng.lognormal(0, 6, n), "ties": np.floor(rng.normal(size=n) * 3), "constant": np.full(n, 7.25),
        "hot": np.where(rng.random(n) < 0.6, 1.0, rng.normal(size=n)),
    }
    rows = [(["a", "b", None][int(x)], *[float(v[i]) for v in values.values()]) for i, x in enumerate(rng.integers(0, 3, n))]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"{c} double" for c in values)).repartition(7)
    for keys in ([], ["g"]):
        got = {(*[r[k] for k in keys], r.name, r.share): r.value for r in Q.exact_quantiles(df, {c: c for c in values}, SHARES, keys, accuracy).collect()}
        want = df.groupBy(*keys).agg(*[F.percentile(c, F.array(*map(F.lit, SHARES))).alias(c) for c in values]).collect()
        assert got == {(*[r[k] for k in keys], c, s): r[c][i] for r in want for c in values for i, s in enumerate(SHARES)}


def test_few_rows_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 3.0, None), (1, 5.0, None), (2, None, 4.0)], "k int, x double, y double").withColumn("v", F.lit(1)).withColumn("n", F.lit(2))
    got = {(r.k, r.name): r.value for r in Q.exact_quantiles(df, {"x": "x", "y": "y"}, [0.25], ["k"]).collect()}
    assert got == {(1, "x"): 3.5, (2, "y"): 4.0}
    wide = {r.k: (r.a, r.b) for r in Q.quantile_columns(df, {"a": ("x", 0.5), "b": ("y", 1.0)}, ["k"]).collect()}
    assert wide == {1: (4.0, None), 2: (None, 4.0)}
    assert Q.exact_quantiles(df.where("k > 5"), {"x": "x"}, [0.5]).collect() == []
    assert Q.quantile_columns(df.where("k > 5"), {"a": ("x", 0.5)}).first().a is None


def test_no_aggregate_holds_all_distinct_values(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("x"))
    found = Q.exact_quantiles(df, {"x": "x"}, [0.5], accuracy=1000)
    plan = found._jdf.queryExecution().toString()
    assert " percentile(" not in plan
    want = df.agg(F.percentile("x", F.lit(0.5))).first()[0]
    assert found.first().value == want
