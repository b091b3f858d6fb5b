"""Loading, rates and resampling of recordings, each by its own clock."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import SECOND
from tidemark.operators import recordings as G
from tidemark.operators import selection as X

T0 = 1_700_000_000 * SECOND


@pytest.mark.parametrize(
    ("data", "uniform", "header", "wanted", "resample", "hz"),
    [
        (99.87, False, None, "infer", True, 100.0),  # rounded to tens
        (104.0, False, None, "infer", True, 100.0), (95.0, False, None, "infer", True, 100.0), (3.0, False, None, "infer", True, 3.0),
        (99.87, False, 50.0, "infer", True, 50.0),  # over a tenth off the header's
        (99.87, False, 105.0, "infer", True, 100.0),
        (99.87, True, None, "infer", False, 100.0),  # even clocks are left alone
        (100.0, True, None, 100.0005, False, 100.0005), (100.0, True, None, 50.0, True, 50.0), (100.0, True, 100.0, 50.0, True, 100.0),
        (99.87, False, 100.0, None, False, 99.87), (None, False, 30.0, "infer", True, 30.0), (None, False, None, "infer", False, None),
    ],
)
def test_decisions(spark, data, uniform, header, wanted, resample, hz):
    df = spark.createDataFrame([("r", data, uniform, header)], "k string, d double, u boolean, h double")
    assert tuple(X.resample_decisions(df, "k", "d", "u", wanted, "h").first())[1:] == (resample, hz)


def test_a_recording_of_unknown_rate_is_an_error(spark):
    df = spark.createDataFrame([("r", None, None)], "k string, d double, h double")
    with pytest.raises(Exception, match="no sample rate is known of r"):
        X.final_rate(df, "k", "d", "h").collect()


def rows_of(name, hz, seconds, jitter=0.0, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(int(hz * seconds)) / hz + rng.uniform(-jitter, jitter, int(hz * seconds)) / hz
    us = T0 + np.rint((t - t[0]) * 1e6).astype(np.int64)
    return [(name, int(u), *map(float, v)) for u, v in zip(us, rng.normal(size=(len(us), 3)) * 0.1 + [0, 0, 1])]


SCHEMA = "recording_id string, us long, x double, y double, z double"


def test_loading_and_even_grids(spark):
    even, uneven = rows_of("even", 25.0, 60), rows_of("uneven", 19.6, 60, 0.2)
    more = [("uneven", uneven[5][1], 9.0, 9.0, 9.0)]  # a repeated time: both go
    late = [("even", T0 + 3 * 86_400 * SECOND, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(even + uneven + more + late, SCHEMA).repartition(4)
    heads = spark.createDataFrame([("uneven", "20.5"), ("even", "none")], "recording_id string, header_hz string")
    series, info = G.load(df, heads, time="us", max_days=2)
    got = {r.recording_id: r for r in info.collect()}
    assert got["even"].n == 1500 and got["even"].data_hz == 25.0 and got["even"].uniform and got["even"].header_hz is None
    assert got["even"].end_us == even[-1][1] + 40_000 and got["uneven"].n == len(uneven) - 1 and not got["uneven"].uniform and got["uneven"].header_hz == 20.5
    rows, rates = G.even(series, info)
    r = {x.recording_id: (x.resample, x.hz, x.differs) for x in rates.collect()}
    assert r == {"even": (False, 25.0, False), "uneven": (True, 20.0, True)}
    own = {x.recording_id: x for x in rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.min("hz").alias("lo"), F.max("hz").alias("hi")).collect()}
    assert own["even"].n == 1500 and own["uneven"].lo == own["uneven"].hi == 20.0
    ticks = [x.us for x in rows.where("recording_id = 'uneven'").orderBy("us").collect()]
    assert set(np.diff(ticks).tolist()) == {50_000} and ticks[0] == uneven[0][1]


def test_incomplete_rows_are_refused(spark):
    for bad in (("r", 1, None, 0.0, 0.0), ("r", 1, float("nan"), 0.0, 0.0), ("r", None, 0.0, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0)):
        with pytest.raises(Exception, match="incomplete row"):
            G.load(spark.createDataFrame([bad], SCHEMA), time="us")
    assert G.load(spark.createDataFrame([], SCHEMA), time="us")[1].count() == 0


def test_the_chain_filters_each_recording_at_its_own_rate(spark):
    a, b = rows_of("a", 10.0, 120), rows_of("b", 29.7, 120, 0.1, seed=2)
    df = spark.createDataFrame(a + b, SCHEMA)
    out = G.process_recordings(df, time="us", lowpass_hz=4.0, calibrated=False, nonwear=False, sleep=False, highpass_hz=None)
    assert {r.recording_id: r.hz for r in out["rates"].collect()} == {"a": 10.0, "b": 30.0}
    for name, rate in (("a", 10.0), ("b", 30.0)):
        one = df.where(F.col("recording_id") == name)
        from tidemark.operators import process as P

        alone = P.process(one, rate, resample=name == "b", lowpass_hz=4.0, calibrated=False, nonwear=False, sleep=False, highpass_hz=None)["series"]
        key = lambda d: [(r.us, round(r.x, 9), round(r.z, 9)) for r in d.where(F.col("recording_id") == name).orderBy("us").collect()]  # noqa: B023, E731
        assert key(out["series"]) == key(alone)
    assert out["info"].count() == 2
