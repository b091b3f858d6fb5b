"""From samples as they are read to validated, truncated, evenly sampled recordings, each at its own rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import SECOND, micros
from tidemark.functions.shared import materialize, remove_tables

from . import process as P
from . import windows as W
from .selection import final_rate, resample_decisions

AXES, KEY, TS = P.AXES, P.KEY, P.TS


def validated(df: DataFrame, time: str = "time", key: str = KEY) -> DataFrame:
    """(recording_id, us, x, y, z): a row without a time, an axis or a recording is an error when the rows are computed."""
    bad = F.col(key).isNull() | F.col(time).isNull()
    for a in AXES:
        bad = bad | F.col(a).isNull() | F.isnan(F.col(a).cast("double"))
    said = F.concat(F.lit("incomplete row in recording "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" at "), F.coalesce(F.col(time).cast("string"), F.lit("null")))
    # Said in both columns, as a step that needs one of them might drop its nulls before the other is computed.
    name = F.when(bad, F.raise_error(said).cast(df.schema[key].dataType)).otherwise(F.col(key)).alias(KEY)
    us = F.col(time).cast("long") if df.schema[time].dataType.simpleString() in ("bigint", "int") else micros(F.col(time).cast("timestamp_ntz"))
    return df.select(name, F.when(bad, F.raise_error(said).cast("long")).otherwise(us).alias(TS), *[F.col(a).cast("double").alias(a) for a in AXES])


def load(df: DataFrame, headers: DataFrame | None = None, *, time: str = "time", key: str = KEY, max_days: float | None = None, resolve_duplicates: bool = True) -> tuple[DataFrame, DataFrame]:
    """(series, info): checked rows, and what is known of each recording.

    In this order: rows beyond ``max_days`` after a recording's first go, incomplete rows are an error, and
    every copy of a repeated time goes (with ``resolve_duplicates``).  ``info`` has (recording_id, n,
    start_us, end_us, data_hz, uniform, header_hz); the end lies one sample after the last row, and
    ``headers`` has (recording_id, header_hz) where known.  An empty recording has no row.
    """
    rows = validated(df, time, key)
    rows = W.truncate_days(rows, KEY, TS, max_days) if max_days else rows
    rows = W.drop_all_duplicates(rows, KEY, TS) if resolve_duplicates else rows
    series = materialize(rows, "loaded")
    return series, materialize(described(series, headers), "info")


def described(series: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(recording_id, n, start_us, end_us, data_hz, uniform, header_hz) of a series."""
    bounds = W.recording_bounds(series, KEY, TS)
    rates = W.sample_rate(series, KEY, TS).select(KEY, F.col("rate_hz").alias("data_hz"), "uniform")
    info = bounds.join(rates, KEY, "left")
    info = info.join(headers.select(KEY, F.col("header_hz").try_cast("double").alias("header_hz")), KEY, "left") if headers is not None else info.withColumn("header_hz", F.lit(None).cast("double"))
    last = F.col("last_us") + F.coalesce(F.round(SECOND / F.col("data_hz")), F.lit(0)).cast("long")
    return info.select(KEY, "n", F.col("first_us").alias("start_us"), last.alias("end_us"), "data_hz", F.coalesce("uniform", F.lit(False)).alias("uniform"), "header_hz")


def even(series: DataFrame, info: DataFrame, resample: float | str | None = "infer") -> tuple[DataFrame, DataFrame]:
    """(series with hz, decisions): recordings whose clock is uneven, or whose rate isn't the one asked for, on an even grid.

    ``resample`` is a rate, ``infer`` (a multiple of ten near each recording's own rate, or its
    header's), or None for none.  Recordings that need nothing pass as they are.  ``hz`` is the rate
    that a recording then has; one of a single row, whose rate no one knows, is an error.
    """
    decisions = resample_decisions(info, KEY, "data_hz", "uniform", resample, "header_hz")
    rates = final_rate(info.join(decisions, KEY).select(KEY, F.when(F.col("resample"), F.col("hz")).otherwise(F.col("data_hz")).alias("data_hz"), "header_hz", "resample"), KEY, "data_hz", "header_hz")
    decided = materialize(decisions.select(KEY, "resample").join(rates, KEY), "rates")
    steps = decided.where("resample").select(KEY, F.round(SECOND / F.col("hz")).cast("long").alias("step_us"))
    chosen = series.join(steps.select(KEY), KEY, "left_semi")
    gridded = W.nearest_resample(chosen, KEY, TS, AXES, steps).select(KEY, F.col("tick_us").alias(TS), *AXES)
    rest = series.join(steps.select(KEY), KEY, "left_anti").select(KEY, TS, *AXES)
    return gridded.unionByName(rest).join(decided.select(KEY, "hz"), KEY), decided


def process_recordings(df: DataFrame, headers: DataFrame | None = None, *, resample: float | str | None = "infer", time: str = "time", key: str = KEY, max_days: float | None = 21.0, resolve_duplicates: bool = True, **steps) -> dict[str, DataFrame]:
    """:func:`.process.process` over raw samples: loaded, resampled where needed, each recording filtered at its own rate.

    Adds ``info`` and ``rates`` to its tables; ``steps`` are its options.  Tables that only later
    steps needed are removed at the end.
    """
    series, info = load(df, headers, time=time, key=key, max_days=max_days, resolve_duplicates=resolve_duplicates)
    rows, rates = even(series, info, resample)
    out = P.process(rows, "hz", max_days=None, **steps)
    remove_tables(series)
    return out | {"info": info, "rates": rates}
