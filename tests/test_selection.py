"""Validation and selection of cohort matrices, and results that were once wrong."""

import math
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohort, evaluation, process, selection
from tidemark.sources import devices


def test_validation_names_what_is_wrong(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (2, float("nan"), 2.0), (3, None, 3.0), (4, 1.0, 4.0)], "time long, x double, y double")
    assert selection.validate(df, ["time", "x", "y"], nan_threshold=0.5) is df
    with pytest.raises(ValueError, match="0.5"):
        selection.validate(df, ["time", "x", "y"])
    with pytest.raises(ValueError, match="missing"):
        selection.validate(df, ["time", "z"])
    with pytest.raises(ValueError, match="unknown"):
        selection.validate(df, ["time", "x"])
    with pytest.raises(ValueError, match="no numbers"):
        selection.validate(df.withColumn("y", F.lit("a")), ["time", "x", "y"])
    assert selection.missing_counts(df.where("false"), ["x"]).first() == (0, 0, 0.0)


def test_selection_edges(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 3.0), (None, 0.5, 50.0)], "id long, a double, b double")
    with pytest.warns(UserWarning, match="zzz"):
        assert selection.select_features(df, ["b", "zzz", "a"], ["id"]).columns == ["id", "b", "a"]
    assert selection.select_features(df, ["b", "a"], in_order_of_table=True).columns == ["a", "b"]
    assert selection.feature_places(df, ["b", "id"]) == [2, 0]
    assert selection.select_samples(df, df, ["id"]).count() == 2
    assert selection.keep_durations(df, "a").count() == 2 and selection.keep_durations(df, "b").count() == 2
    with pytest.raises(ValueError, match="differ"):
        selection.merge_sets(df, df.drop("a"))
    assert set(selection.split_sets(df, "id")) == {1}


def test_nights_whose_bouts_disagree_are_an_error(spark):
    features = spark.createDataFrame([("p", 1, 5)], "id string, night int, n int")
    bouts = spark.createDataFrame([("p", 1, "x"), ("p", 1, "y"), ("p", 2, "z")], "id string, night int, diagnosis string")
    with pytest.raises(Exception, match="several values of diagnosis"):
        selection.attach_night_metadata(features, bouts, ["id", "night"], ["diagnosis"]).collect()
    with pytest.raises(Exception, match="more than once"):
        selection.attach_night_metadata(features.union(features), bouts.where("diagnosis <> 'y'"), ["id", "night"], ["diagnosis"]).collect()
    assert selection.attach_night_metadata(features, bouts.where("diagnosis <> 'y'"), ["id", "night"], ["diagnosis"]).first().diagnosis == "x"


def test_student_quantiles(spark):
    known = {1: 12.706205, 2: 4.302653, 5: 2.570582, 10: 2.228139, 15: 2.131450, 16: 2.119905, 30: 2.042272, 120: 1.979930}
    df = spark.createDataFrame([(k,) for k in known], "k int")
    for r in df.select("k", evaluation.t_quantiles(F.col("k")).alias("t")).collect():
        assert r.t == pytest.approx(known[r.k], abs=1e-5)
    one = evaluation.mean_ci(spark.createDataFrame([(1.0,)], "v double"), "v").first()
    assert one.lower is None and one.mean == 1.0
    two = evaluation.mean_ci(spark.createDataFrame([(1.0,), (3.0,)], "v double"), "v").first()
    assert two.upper == pytest.approx(2 + 12.706205 * math.sqrt(2) / math.sqrt(2), rel=1e-6)


@pytest.mark.parametrize(("minor", "major"), [(7, 40), (2, 9), (1, 5), (12, 12)])
def test_synthetic_rows_balance_the_classes_exactly(spark, minor, major):
    rng = np.random.default_rng(minor)
    rows = [(i, int(i < minor), float(a), float(b)) for i, (a, b) in enumerate(rng.random((minor + major, 2)))]
    got = cohort.smote(spark.createDataFrame(rows, "id long, y int, a double, b double"), "id", "y", ["a", "b"]).collect()
    assert len(got) == major - minor
    made = Counter(r.base for r in got)
    assert not made or max(made.values()) - min([made[i] for i in range(minor)]) <= 1


def test_each_csv_header_places_its_own_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,x,y,z\n2024-01-01 00:00:00,1,2,3\n")
    (tmp_path / "b.csv").write_text("time;z;y;x\n2024-01-01 00:00:01;3;2;1\n")
    (tmp_path / "c.csv").write_text("2024-01-01 00:00:02,1,2,3\n")
    rows = devices.read_csv(spark, f"{tmp_path}/*.csv").collect()
    assert len(rows) == 3 and {(r.x, r.y, r.z) for r in rows} == {(1.0, 2.0, 3.0)}


@pytest.mark.parametrize(("upper", "device"), [(0, 777), (2, 2 * 65536 + 777), (0xFFFF, 777)])
def test_upper_half_of_the_device_number(upper, device):
    head = bytearray(1024)
    head[:2] = b"MD"
    struct.pack_into("<HIH", head, 5, 777, 9, upper)
    assert (devices.cwa_header(bytes(head))["device"], devices.cwa_header(bytes(head))["session"]) == (device, 9)


def test_the_whole_chain_computes_each_step_once(spark):
    rng = np.random.default_rng(0)
    rows = [("r", i * 100_000, *map(float, rng.normal(0, 0.2, 3) + [0, 0, 1])) for i in range(3000)]
    out = process.process(spark.createDataFrame(rows, "recording_id string, us long, x double, y double, z double"), 10.0, lowpass_hz=4.0)
    plan = out["bouts"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("LogicalRDD") < 10
    assert "PythonUDF" not in plan and "FlatMapGroupsInPandas" not in plan
    assert out["series"].count() == 3000 and out["bouts"].count() == 0
