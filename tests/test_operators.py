"""Rules at their edges, on small hand-made tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import DAY, HOUR, MINUTE, SECOND
from tidemark.operators import cohort as C
from tidemark.operators import evaluation as V
from tidemark.operators import kernels as K
from tidemark.operators import nights as N
from tidemark.operators import process as P
from tidemark.operators import segments as S
from tidemark.operators import windows as W


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_sessions_cross_buckets_and_keep_rows_one_gap_apart(spark):
    t = [DAY - 2, DAY - 1, DAY + 4, DAY + 9, DAY + 15, None]
    df = spark.createDataFrame([("a", v, 1.0) for v in t], "k string, t long, v double")
    out = S.sessionize(df, "k", "t", 5, {"s": ("sum", F.col("v"))})
    assert rows(out, "start_us", "end_us", "n", "s") == [(DAY - 2, DAY + 9, 4, 4.0), (DAY + 15, DAY + 15, 1, 1.0)]
    assert S.sessionize(df.where("false"), "k", "t", 5).collect() == []


def test_runs_keep_single_rows_and_cross_buckets(spark):
    flags = [(0, True), (1, False), (DAY - 1, True), (DAY, True), (DAY + 1, None), (DAY + 2, True)]
    df = spark.createDataFrame([("a", t, f) for t, f in flags], "k string, t long, f boolean")
    assert rows(S.runs(df, "k", "t", F.col("f")), "start_us", "end_us", "n") == [(0, 0, 1), (DAY - 1, DAY, 2), (DAY + 2, DAY + 2, 1)]


def test_merge_gaps_drops_short_ones_first(spark):
    iv = spark.createDataFrame([("a", 0, 40), ("a", 45, 50), ("a", 95, 140), ("a", 200, 240)], "k string, start_us long, end_us long")
    assert rows(S.merge_gaps(iv, "k", 60, 30), "start_us", "end_us", "parts") == [(0, 140, 2), (200, 240, 1)]
    assert rows(S.merge_gaps(iv, "k", 60, 41), "start_us", "end_us", "parts") == [(95, 140, 1)]


@pytest.mark.parametrize(
    ("start", "end", "hours"),
    [(23 * HOUR, DAY + 7 * HOUR, 8.0), (20 * HOUR, 23 * HOUR, 1.0), (1 * HOUR, 4 * HOUR, 3.0), (12 * HOUR, DAY + 12 * HOUR, 11.0), (0, 3 * DAY, 0.0)],
)
def test_night_overlap(spark, start, end, hours):
    got = spark.range(1).select(S.night_overlap_hours(F.lit(10 * DAY + start), F.lit(10 * DAY + end)).alias("h")).first().h
    assert got == pytest.approx(hours)


def test_intervals_at_their_ends_and_overlapping(spark):
    iv = spark.createDataFrame([("a", 10, 20), ("a", 15, DAY + 5), ("b", 0, 1)], "k string, start_us long, end_us long")
    df = spark.createDataFrame([("a", t) for t in (9, 10, 20, DAY + 5, DAY + 6)] + [("c", 10)], "k string, t long")
    out = S.in_intervals(df, iv, "k", "t", "m")
    assert rows(out, "k", "t", "m") == [("a", 9, False), ("a", 10, True), ("a", 20, True), ("a", DAY + 5, True), ("a", DAY + 6, False), ("c", 10, False)]


def test_conflict_rules(spark):
    d0 = 10 * DAY
    windows = [("n", d0 + 22 * HOUR, d0 + 31 * HOUR), ("d", d0 + 12 * HOUR, d0 + 20 * HOUR), ("o", d0 + 11 * HOUR, d0 + DAY + 12 * HOUR)]
    bounds = [(k, d0, d0 + 3 * DAY) for k in "ndo"]
    runs = {
        ("n", d0 + 23 * HOUR, d0 + 25 * HOUR): "R3",
        ("n", d0 + 23 * HOUR, d0 + 28 * HOUR): "none",
        ("d", d0 + 13 * HOUR, d0 + 15 * HOUR): "R5",
        ("o", d0 + 12 * HOUR, d0 + 14 * HOUR): "R6",
        ("o", d0 + 12 * HOUR, d0 + 18 * HOUR): "R5",
        ("o", d0 + 30 * HOUR, d0 + 35 * HOUR): "R4",
        ("d", d0 + 21 * HOUR, d0 + 22 * HOUR): "none",
    }
    sch = "k string, start_us long, end_us long"
    out = S.conflict_rules(spark.createDataFrame(list(runs), sch), spark.createDataFrame(windows, sch), spark.createDataFrame(bounds, "k string, first_us long, last_us long"), "k")
    assert {(r.k, r.start_us, r.end_us): r.rule for r in out.collect()} == runs
    early = S.conflict_rules(spark.createDataFrame([("n", d0 + 22 * HOUR, d0 + 23 * HOUR)], sch), spark.createDataFrame(windows, sch), spark.createDataFrame([("n", d0 + 20 * HOUR, d0 + 9 * DAY)], "k string, first_us long, last_us long"), "k")
    assert early.first().rule == "R1"
    late = spark.createDataFrame([("n", d0, d0 + 31 * HOUR)], "k string, first_us long, last_us long")
    assert S.conflict_rules(spark.createDataFrame([("n", d0 + 24 * HOUR, d0 + 30 * HOUR)], sch), spark.createDataFrame(windows, sch), late, "k").first().rule == "R2a"
    assert S.conflict_rules(spark.createDataFrame([("n", d0 + 28 * HOUR, d0 + 30 * HOUR)], sch), spark.createDataFrame(windows, sch), late, "k").first().rule == "R2b"


def test_nonwear_run_breaks_at_a_missing_window(spark):
    w = spark.createDataFrame([("a", i, i * 10, 0.0) for i in range(10) if i != 5], "k string, window long, start_us long, std_x double")
    assert rows(W.nonwear(w, "k", ["x"], 0.1, 20), "start_us", "end_us", "windows") == [(0, 40, 5), (60, 90, 4)]


def test_nearest_resample_ties_and_gaps(spark):
    h = HOUR
    df = spark.createDataFrame([("a", 5 * h, 1.0), ("a", 7 * h, 2.0), ("a", 77 * h, 3.0)], "k string, t long, v double")
    out = {r.tick: (r.tick_us, r.v) for r in W.nearest_resample(df, "k", "t", ["v"], h).collect()}
    assert len(out) == 73
    assert [out[i][1] for i in (0, 1, 2, 3, 37, 38, 72)] == [1.0, 1.0, 2.0, 2.0, 2.0, 3.0, 3.0]
    assert all(us == 5 * h + i * h for i, (us, _) in out.items())


@pytest.mark.parametrize(("start", "slices"), [(8, [0, 0, 1]), (15, [0, 1, 2]), (0, [0, 0, 1])])
def test_noon_slices(spark, start, slices):
    first = 10 * DAY + start * HOUR
    t = [first, 11 * DAY + 11 * HOUR + (HOUR * 2 if start == 15 else 0), 12 * DAY + 13 * HOUR if start == 15 else 11 * DAY + 13 * HOUR]
    df = spark.createDataFrame([(v,) for v in t], "t long").select(W.noon_slice(F.col("t"), F.lit(first)).alias("s"))
    assert [r.s for r in df.collect()] == slices


def test_duplicates_all_go(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "k string, t long")
    assert rows(W.drop_all_duplicates(df, "k", "t"), "t") == [(2,)]


def test_votes_at_their_thresholds(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 1), ("b", 0.9, 0), ("b", 0.1, 0)], "id string, p double, y int")
    got = {r.id: (r.mean_vote, r.majority, r.ensemble_any, r.ensemble_all) for r in V.patient_votes(df, "id", "p", "y").collect()}
    assert got == {"a": (False, True, True, False), "b": (False, True, True, False)}


def test_auc_equals_pairs(spark):
    rng = np.random.default_rng(5)
    s, y = np.round(rng.random(200), 2), rng.integers(0, 2, 200)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    pairs = np.sign(np.subtract.outer(s[y == 1], s[y == 0]))
    assert V.roc_auc(V.curve(df, "s", "y")).first().roc_auc == pytest.approx(((pairs + 1) / 2).mean())


def test_chunked_filter_equals_the_whole_signal(spark):
    from tidemark.functions import dsp

    fs, n = 50.0, 6000
    rng = np.random.default_rng(2)
    v = np.cumsum(rng.normal(size=n)) * 0.01
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "us": (np.arange(n) * SECOND / fs).astype(np.int64), "v": v}))
    out = K.butterworth_filter(df, "k", "us", ["v"], fs, low=0.8, chunk=40 * SECOND).toPandas().sort_values("us")
    whole = dsp.zero_phase(v, dsp.butterworth(5, 0.8, None, fs))
    assert len(out) == n
    assert np.abs(out["v"].to_numpy() - whole).max() < 1e-6


def test_forward_medians_at_chunk_edges(spark):
    v = np.random.default_rng(4).normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "us": np.arange(300) * SECOND, "v": v}))
    out = K.forward_medians(df, "k", "us", ["v"], 7, 1.0, chunk=60 * SECOND).toPandas().sort_values("us")["v"].to_numpy()
    assert np.allclose(out[:294], [np.median(v[i : i + 7]) for i in range(294)])
    assert np.isnan(out[294:]).all()


def test_cohort_rules(spark):
    df = spark.createDataFrame([("s1", None, "a"), ("s1", "rec1", "b"), ("s1", " ", "c"), ("s2", None, "d")], "ID string, record_ID string, f string")
    assert rows(C.fill_record_ids(df, "ID", "record_ID", "f").fillna("-"), "f", "record_ID") == [("a", "rec2"), ("b", "rec1"), ("c", "rec3"), ("d", "-")]
    key = df.select(C.record_key("ID", "record_ID").alias("k")).distinct()
    assert rows(key, "k") == [("s1",), ("s1_rec1",), ("s2",)]
    meta = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 30.0), ("d", 60.0), ("Total", 1.0)], "n string, v double")
    assert rows(C.drop_summary_rows(meta, ["n"], ["v"]), "n") == [("a",), ("b",), ("c",), ("d",)]


def test_threshold_runs_round_the_limit_as_their_sql(spark, tmp_path):
    from datetime import datetime

    import duckdb

    from tidemark.plans import catalogue

    # Four times the first user's quantile is 28.52 in the SQL and the next number above it in Spark's percentile.
    values = {1: [5.15, 28.52, 10.1, 200.0, 300.0], 2: [7.86, 31.76, 7.96, 50.0, 60.0, 70.0, 8.0, 80.0, 9.0], 3: [4.0, 16.0, 4.0, None, 90.0], 4: [None, None]}
    events = [(k * 100 + i, k, datetime(2024, 1, 1, 13, i), "a", v) for k, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.queries()["percentile_threshold_runs"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(got.columns)} from ({catalogue.oracle_sql()['percentile_threshold_runs']})").fetchall()
    assert rows(got, *got.columns) == sorted(want)


def test_group_folds_are_disjoint_and_smote_balances(spark):
    df = spark.createDataFrame([(i, f"g{i % 17}", int(i % 4 == 0), float(i % 7), float(i % 5)) for i in range(200)], "id long, g string, y int, a double, b double")
    folds = C.group_folds(df, "g", "y", 4).toPandas()
    assert folds["g"].is_unique
    assert set(folds["fold"]) == {0, 1, 2, 3}
    made = C.smote(df, "id", "y", ["a", "b"]).toPandas()
    assert 0 < len(made) <= 150
    assert made["a"].between(0, 6).all()


def test_night_statistics_of_tiny_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, v double")
    got = {r.k: (r.v_skew, r.v_kurt, r.v_mad) for r in N.eight_statistics(df, ["k"], ["v"]).collect()}
    assert got == {"a": (None, None, 0.5), "b": (None, None, 0.0)}


def test_process_finds_a_planted_night(spark):
    fs = 1.0
    hours = np.arange(int(30 * 3600 * fs)) / 3600 + 15
    rng = np.random.default_rng(8)
    asleep = (hours >= 23) & (hours < 31)
    angle = np.where(asleep, 0.2, np.cumsum(rng.normal(scale=0.8, size=len(hours))))
    x, z = np.cos(angle), np.sin(angle)
    x, y, z = (a + rng.normal(scale=0.03, size=len(hours)) for a in (x, np.zeros(len(hours)), z))
    burst = np.flatnonzero(asleep)[5000:5004]
    y[burst] += 2.0
    df = spark.createDataFrame(pd.DataFrame({"recording_id": "r", "us": (10 * DAY + hours * HOUR).astype(np.int64), "x": x, "y": y, "z": z}))
    out = P.process(df, fs, lowpass_hz=None, highpass_hz=None, calibrated=False, nonwear=True)
    nights = out["nights"].collect()
    assert len(nights) == 1
    assert abs(nights[0].start_us - (10 * DAY + 23 * HOUR)) < 20 * MINUTE
    assert abs(nights[0].end_us - (10 * DAY + 31 * HOUR)) < 20 * MINUTE
    bouts = out["bouts"].collect()
    assert any(b.start_us <= 10 * DAY + hours[burst[0]] * HOUR + SECOND and b.end_us >= 10 * DAY + hours[burst[-1]] * HOUR - SECOND for b in bouts)
