"""Steps whose tasks must not grow with the input: what they keep in memory, read or make anew for each group."""

import numpy as np

from tidemark.functions import dsp
from tidemark.operators import cohort as C
from tidemark.operators import nights as N
from tidemark.operators import ranking as R
from tidemark.operators import significance as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark):
    return spark.createDataFrame([(i % 3, float(i % 7), float(i)) for i in range(60)], "y int, a double, b double")


def test_filter_makes_its_responses_once():
    sections = dsp.butterworth(5, None, 8.0, 32.0)
    dsp.zero_phase(np.arange(64.0), sections)
    made = dsp._responses.cache_info().misses
    dsp.zero_phase(np.arange(64.0)[::-1], sections)
    assert dsp._responses.cache_info().misses == made


def test_values_are_dealt_before_correlations_count_them(spark):
    df = table(spark).where("y < 2")
    assert "REPARTITION_BY_NUM" in plan(R.label_correlations(df, ["a", "b"], "y"))
    assert "REPARTITION_BY_NUM" in plan(R.average_ranks(df, "a"))
    assert "REPARTITION_BY_NUM" in plan(R.mann_whitney_u(df, "a", "y", 0, 1))


def test_values_are_dealt_before_significance_counts_them(spark):
    assert "REPARTITION_BY_NUM" in plan(S.rank_significance(table(spark), ["a", "b"], "y", 0, 1))


def test_values_are_dealt_before_normal_distance_counts_them(spark):
    assert "REPARTITION_BY_NUM" in plan(S.normal_distance(table(spark), ["a", "b"]))


def test_scale_parameters_go_to_the_rows(spark):
    df = table(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(R.apply_scale(df, R.scale_parameters(df.where("y > 0"), ["a", "b"], "standard", ["y"]), ["a", "b"], ["y"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in found


def test_fold_rows_are_dealt_before_they_are_grouped(spark):
    rows = [(s, 1, o, i, "test" if s % 2 == o else "train") for s in range(6) for o in (0, 1) for i in (0, 1)]
    schema = "subject_id int, repeat int, outer_fold int, inner_fold int, role string"
    checked = C.check_folds(spark.createDataFrame(rows, schema))
    assert "REPARTITION_BY_NUM" in plan(checked)
    assert checked.collect() == []
    bad = [*rows[:-1], (5, 1, 1, 1, "train"), (0, 1, 0, 0, "train"), (9, 1, 0, 0, "train")]
    assert {r.problem: r.n for r in C.check_folds(spark.createDataFrame(bad, schema)).collect()} == {"overlap": 1, "test_moves": 1, "not_tested_once": 1}


def test_night_quantiles_without_maps_of_values(spark):
    values = {"a": [3.0, 1.0, 2.0, 2.0, 9.0, None], "b": [5.0], "c": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    found = N.eight_statistics(df, ["k"], ["v"])
    assert "percentile" not in plan(found)
    got = {r.k: (r.v_p10, r.v_iqr, r.v_p90) for r in found.collect()}
    p = lambda q: float(np.quantile([3.0, 1.0, 2.0, 2.0, 9.0], q))
    assert np.allclose(got["a"], (p(0.1), p(0.75) - p(0.25), p(0.9)))
    assert got["b"] == (5.0, 0.0, 5.0) and got["c"] == (None, None, None)
