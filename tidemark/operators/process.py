"""From raw tri-axial recordings to calibrated, annotated series, nights and movement bouts.

Every step is a DataFrame to DataFrame function; ``process`` chains those that are asked for, in
the order that matters: gravity is removed last, since sleep detection needs it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dsp
from tidemark.functions.columns import HOUR, MINUTE, SECOND, micros
from tidemark.functions.shared import materialize, remove_tables

from . import kernels
from . import segments as S
from . import windows as W

AXES = ["x", "y", "z"]
KEY, TS = "recording_id", "us"


def raw_series(df: DataFrame, time: str = "time", key: str = KEY) -> DataFrame:
    """(recording_id, us, x, y, z) of complete rows; every copy of a repeated time goes."""
    rows = df.select(F.col(key).alias(KEY), micros(time).alias(TS), *[F.col(a).cast("double").alias(a) for a in AXES]).dropna()
    return W.drop_all_duplicates(rows, KEY, TS)


def calibration(df: DataFrame, width: int = 10 * SECOND, still: float = 0.015, least: int = 50, span: float = 0.3, accept: float = 0.01) -> DataFrame:
    """(recording_id, status, error, ox .. gz): fit of each recording's still window means to the unit sphere.

    The points are one row a window, tens of thousands for a recording of weeks; status is
    'ok' or says why the recording keeps its values.
    """
    t = W.tumbling_windows(df, KEY, TS, width, AXES)
    calm = t.where(" and ".join(f"std_{a} < {still}" for a in AXES))
    schema = f"{KEY} {df.schema[KEY].dataType.simpleString()}, status string, error double, points long, ox double, oy double, oz double, gx double, gy double, gz double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[[f"mean_{a}" for a in AXES]].to_numpy(float)
        head = {KEY: pdf[KEY].iloc[0], "error": float("nan"), "points": len(p), "ox": 0.0, "oy": 0.0, "oz": 0.0, "gx": 1.0, "gy": 1.0, "gz": 1.0}
        if len(p) < least:
            return pd.DataFrame([head | {"status": "too few points"}])
        if not ((p.min(0) < -span) & (p.max(0) > span)).all():
            return pd.DataFrame([head | {"status": "sphere not covered"}])
        offset, gain, error, rounds = dsp.sphere_fit(p)
        ok = error <= accept and rounds < 1000
        found = dict(zip(("ox", "oy", "oz", "gx", "gy", "gz"), [*offset, *gain], strict=True)) if ok else {}
        return pd.DataFrame([head | {"status": "ok" if ok else "error too large", "error": error} | found])

    return calm.groupBy(KEY).applyInPandas(fit, schema)


def calibrate(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """Axes by offset and gain of their recording; a recording without parameters keeps its values."""
    j = df.join(parameters.select(KEY, *[f"{p}{a}" for a in AXES for p in "og"]), KEY, "left")
    return j.select(*[c for c in df.columns if c not in AXES], *[(F.coalesce(f"o{a}", F.lit(0.0)) + F.coalesce(f"g{a}", F.lit(1.0)) * F.col(a)).alias(a) for a in AXES])


def non_wear(df: DataFrame, width: int = 10 * SECOND, still: float = 0.015, longest: int = 60 * MINUTE) -> DataFrame:
    return W.nonwear(W.tumbling_windows(df, KEY, TS, width, AXES), KEY, AXES, still, longest)


def angle_changes(df: DataFrame, fs: float | str, epoch_s: int = 5) -> DataFrame:
    """(recording_id, epoch, us, change): mean z angle of forward-median axes for each epoch of rows, and its absolute step.

    ``fs`` is the rate of all recordings, or the column that has each one's.
    """
    own = isinstance(fs, str)
    first = df.groupBy(KEY).agg(F.min(TS).alias("_first"))
    rows = df.select(KEY, TS, *AXES, *([fs] if own else []))
    medians = kernels.forward_medians(rows, KEY, TS, AXES, None if own else int(fs * epoch_s), fs, seconds=epoch_s).dropna()
    step = int(epoch_s * SECOND)
    at = medians.join(first, KEY).withColumn("epoch", F.floor((F.col(TS) - F.col("_first")) / step))
    angle = at.groupBy(KEY, "_first", "epoch").agg(F.avg(W.z_angle(*[F.col(a) for a in AXES])).alias("angle"))
    w = Window.partitionBy(KEY).orderBy("epoch")
    change = F.coalesce(F.abs(F.col("angle") - F.lag("angle").over(w)), F.lit(0.0))
    return angle.select(KEY, "epoch", (F.col("_first") + F.col("epoch") * step).alias(TS), change.alias("change"))


def sleep_windows(changes: DataFrame, smooth: int = 75, q: float = 0.1, factor: float = 15.0, least: int = 30 * MINUTE, gap: int = 60 * MINUTE, least_epochs: int = 2160) -> DataFrame:
    """(recording_id, slice, start_us, end_us): runs of small smoothed angle changes in each noon-to-noon slice, short ones dropped, then near ones merged."""
    w = Window.partitionBy(KEY).orderBy("epoch").rowsBetween(0, smooth - 1)
    first = changes.groupBy(KEY).agg(F.min(TS).alias("_first"))
    rows = changes.withColumn("s", F.when(F.count(F.lit(1)).over(w) == smooth, F.percentile("change", F.lit(0.5)).over(w))).where("s is not null")
    rows = rows.join(first, KEY).withColumn("slice", W.noon_slice(F.col(TS), F.col("_first")))
    big = rows.groupBy(KEY, "slice").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least_epochs).drop("_n")
    rows = rows.join(big, [KEY, "slice"], "left_semi")
    found = W.threshold_runs(rows, [KEY, "slice"], TS, "s", q, factor).withColumn("_k", F.struct(KEY, "slice"))
    merged = S.merge_gaps(found, "_k", gap, least)
    return merged.select(f"_k.{KEY}", "_k.slice", "start_us", "end_us")


def sleep_bouts(changes: DataFrame, windows: DataFrame, limit: float = 5.0, least: int = 5 * MINUTE) -> DataFrame:
    """(recording_id, start_us, end_us): runs inside the windows with changes up to ``limit``, of ``least`` or more."""
    inside = S.in_intervals(changes, windows, KEY, TS, "_in").where("_in")
    calm = S.runs(inside, KEY, TS, F.col("change") <= limit)
    return calm.where(F.col("end_us") - F.col("start_us") >= least)


def movement_threshold(df: DataFrame, floor: float = 0.1) -> DataFrame:
    """(recording_id, limit): mean and deviation of the magnitude over worn sleep, at least ``floor``."""
    asleep = df.where("sptw and wear").withColumn("m", F.sqrt(sum((F.col(a) * F.col(a) for a in AXES), F.lit(0.0))))
    return asleep.groupBy(KEY).agg(F.greatest(F.avg("m") + F.stddev_pop("m"), F.lit(floor)).alias("limit"))


def movement_bouts(df: DataFrame, nights: DataFrame, gap: int = SECOND, threshold: DataFrame | None = None) -> DataFrame:
    """(recording_id, session, start_us, end_us, n): worn sleep samples over the recording's threshold in a night, joined over gaps up to ``gap``.

    A recording with one such sample or none has no bouts.
    """
    limit = movement_threshold(df) if threshold is None else threshold
    m = F.sqrt(sum((F.col(a) * F.col(a) for a in AXES), F.lit(0.0)))
    hits = S.in_intervals(df.where("sptw and wear").join(limit, KEY).where(m > F.col("limit")), nights, KEY, TS, "_night").where("_night")
    some = hits.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(KEY)
    return S.sessionize(hits.join(some, KEY, "left_semi"), KEY, TS, gap)


def process(
    df: DataFrame, fs: float | str, *, resample: bool = False, lowpass_hz: float | None = 20.0, highpass_hz: float | None = 0.8, calibrated: bool = True,
    nonwear: bool = True, sleep: bool = True, max_days: float | None = 21.0,
) -> dict[str, DataFrame]:
    """Tables of a cohort's recordings: ``series`` (annotated), and with sleep ``windows``, ``nights``, ``sleep_bouts``, ``bouts``, ``stats``.

    ``fs`` is the rate of all recordings, or the column of ``df`` that has each one's (then nothing
    is resampled here; :mod:`.recordings` does that).  Only the steps that are asked for run; without non-wear detection everything counts as worn.
    Filtered and calibrated rows, intervals and annotated rows are written to the shared folder once
    each, so no signal kernel runs twice; tables that no result reads are removed at the end.
    """
    if resample and isinstance(fs, str):
        raise ValueError("resampling here needs one rate")
    rows = W.truncate_days(df, KEY, TS, max_days) if max_days else df
    if resample:
        rows = W.nearest_resample(rows, KEY, TS, AXES, round(SECOND / fs)).select(KEY, F.col("tick_us").alias(TS), *AXES)
    if lowpass_hz:
        rows = kernels.butterworth_filter(rows, KEY, TS, AXES, fs, high=lowpass_hz)
    out, spent = {}, []
    if calibrated:
        rows = materialize(rows, "filtered")
        spent.append(rows)
        out["calibration"] = materialize(calibration(rows), "calibration")
        rows = calibrate(rows, out["calibration"])
    gravity = rows = materialize(rows, "gravity")
    off = materialize(non_wear(gravity), "nonwear") if nonwear else None
    if sleep:
        spent += [gravity, *([off] if nonwear else [])]
    if highpass_hz:
        rows = kernels.butterworth_filter(rows, KEY, TS, AXES, fs, low=highpass_hz)
    rows = S.in_intervals(rows, off, KEY, TS, "_off").withColumn("wear", ~F.col("_off")).drop("_off") if nonwear else rows.withColumn("wear", F.lit(True))
    if sleep:
        rows = materialize(rows, "worn")
        changes = materialize(angle_changes(gravity, fs), "changes")
        windows = materialize(sleep_windows(changes), "windows")
        spent += [rows, changes, windows]
        short = windows.where(F.col("end_us") - F.col("start_us") <= 16 * HOUR)
        calm = materialize(sleep_bouts(changes, short), "calm")
        if nonwear:
            bounds = W.recording_bounds(gravity, KEY, TS).drop("n")
            touched = S.in_intervals(rows, short, KEY, TS, "_s")
            doubt = S.runs(touched, KEY, TS, ~F.col("wear") & F.col("_s"))
            actions = materialize(S.conflict_rules(doubt, short, bounds, KEY), "conflicts")
            out["conflicts"] = actions
            clear = actions.where("clear_from_us is not null").select(KEY, F.col("clear_from_us").alias("start_us"), F.col("clear_to_us").alias("end_us")).where("start_us <= end_us")
            rows = S.in_intervals(touched, clear, KEY, TS, "_clear")
            rows = S.in_intervals(rows, actions.where("set_wear"), KEY, TS, "_worn")
            rows = rows.withColumn("sptw", F.col("_s") & ~F.col("_clear")).withColumn("wear", F.col("wear") | F.col("_worn")).drop("_s", "_clear", "_worn")
        else:
            rows = S.in_intervals(rows, short, KEY, TS, "sptw")
        rows = S.in_intervals(rows, calm, KEY, TS, "sleep_bout").withColumn("sleep_bout", F.col("sleep_bout") & F.col("sptw"))
        rows = materialize(rows, "series")
        final = materialize(S.runs(rows, KEY, TS, F.col("sptw")), "sptw")
        nights = materialize(S.select_nights(final, KEY), "nights")
        out |= {"windows": final, "nights": nights, "sleep_bouts": calm, "bouts": movement_bouts(rows, nights), "stats": S.window_stats(final, calm, KEY)}
        remove_tables(*spent)
    return out | {"series": rows}
