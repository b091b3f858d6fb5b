"""Cohort matrices: validation, selection, calendar parts, metadata, merging, splitting, and choices of rate.

Null and repeated rows pass through unless a function says otherwise; empty tables give empty results.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .windows import target_rate


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, incomplete, share) of the table: rows that lack a value (null or NaN) in any of the columns; the share of an empty table is 0."""
    lacks = F.lit(False)
    for c in columns:
        bad = F.col(c).isNull()
        if df.schema[c].dataType.simpleString() in ("double", "float"):
            bad = bad | F.isnan(c)
        lacks = lacks | bad
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(lacks.cast("long")), F.lit(0)).alias("incomplete"))
    return counts.select("rows", "incomplete", F.when(F.col("rows") > 0, F.col("incomplete") / F.col("rows")).otherwise(F.lit(0.0)).alias("share"))


def validate(df: DataFrame, required: list[str], optional: list[str] = (), nan_threshold: float = 0.0) -> DataFrame:
    """``df`` if it has the required columns (numbers but for the first, the time), no column beyond them and the optional ones,
    and at most the given share of rows that lack a value; else ValueError."""
    lack = [c for c in required if c not in df.columns]
    extra = [c for c in df.columns if c not in {*required, *optional}]
    text = [c for c in required[1:] if c in df.columns and not isinstance(df.schema[c].dataType, NumericType)]
    if lack or extra or text:
        raise ValueError(f"missing columns {lack}, unknown columns {extra}, columns that are no numbers {text}")
    share = missing_counts(df, list(required)).first().share
    if share > nan_threshold:
        raise ValueError(f"{share:.6f} of the rows lack values, more than {nan_threshold}")
    return df


def keep_durations(df: DataFrame, column: str = "time_diff", over: float = 0.5, under: float = 50.0) -> DataFrame:
    """Bouts strictly longer and shorter than the bounds; those without a duration go."""
    return df.where((F.col(column) > over) & (F.col(column) < under))


def calendar_parts(df: DataFrame, time: str) -> DataFrame:
    """``df`` with month, day, hour and minute of the time; null for a null time."""
    return df.withColumns({"month": F.month(time), "day": F.dayofmonth(time), "hour": F.hour(time), "minute": F.minute(time)})


def duration_seconds(df: DataFrame, key: str, us: str) -> DataFrame:
    """(key, duration_sec): last less first time of each group."""
    return df.groupBy(key).agg(((F.max(us) - F.min(us)) / 1e6).alias("duration_sec"))


def select_features(df: DataFrame, names: list[str], keys: list[str] = (), in_order_of_table: bool = False) -> DataFrame:
    """Keys and the named features, as asked or in the table's order; names that are absent only warn."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        warnings.warn(f"features not in the table: {absent}", stacklevel=2)
    wanted = [n for n in dict.fromkeys(names) if n in df.columns]
    return df.select(*keys, *([c for c in df.columns if c in wanted] if in_order_of_table else wanted))


def feature_places(df: DataFrame, names: list[str]) -> list[int]:
    """Places of the named columns; an absent one is an error."""
    return [df.columns.index(n) for n in names]


def select_samples(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are among the wanted ones, repeats and all; null keys match nothing."""
    return df.join(wanted.select(*keys).distinct(), keys, "left_semi")


def strat_label(label: str, dataset: str | None = None) -> Column:
    """The class, or data set and class, by which folds are balanced."""
    own = F.col(label).cast("string")
    return own if dataset is None else F.concat_ws("_", F.col(dataset).cast("string"), own)


def merge_sets(*sets: DataFrame) -> DataFrame:
    """The sets' rows under one another, columns by name; differing columns are an error."""
    first = sets[0]
    for other in sets[1:]:
        if set(other.columns) != set(first.columns):
            raise ValueError(f"columns differ: {sorted(set(other.columns) ^ set(first.columns))}")
        first = first.unionByName(other)
    return first


def split_sets(df: DataFrame, dataset: str) -> dict[str, DataFrame]:
    """A frame for each data set; the names are read, a row each."""
    return {r[0]: df.where(F.col(dataset) == r[0]) for r in df.select(dataset).where(F.col(dataset).isNotNull()).distinct().orderBy(dataset).collect()}


def split_problems(splits: DataFrame, index: str, split: str, role: str, n: int) -> DataFrame:
    """(split, problem, n): train and test places that repeat, lie outside 0 .. n - 1 or are in both roles, and splits that lack a role."""
    count = F.count(F.lit(1)).alias("n")
    twice = splits.groupBy(split, role, index).agg(F.count(F.lit(1)).alias("k")).where("k > 1").groupBy(split).agg(count).select(split, F.lit("repeated").alias("problem"), "n")
    outside = splits.where(F.col(index).isNull() | (F.col(index) < 0) | (F.col(index) >= n)).groupBy(split).agg(count).select(split, F.lit("outside"), "n")
    both = splits.groupBy(split, index).agg(F.countDistinct(role).alias("k")).where("k > 1").groupBy(split).agg(count).select(split, F.lit("in_both"), "n")
    lacks = splits.groupBy(split).agg(F.countDistinct(role).alias("k")).where("k < 2").select(split, F.lit("lacks_a_role"), F.lit(1).cast("long").alias("n"))
    return twice.union(outside).union(both).union(lacks)


def attach_night_metadata(features: DataFrame, bouts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``features`` with the metadata columns of its nights, one row to one row.

    A night whose bouts disagree on a column, or keys that repeat in ``features``, are an error
    when the result is computed; nights without bouts get nulls.
    """
    once = bouts.groupBy(*keys).agg(*[F.min(c).alias(c) for c in columns], *[F.countDistinct(c).alias(f"_n_{c}") for c in columns])
    clash = [F.when(F.col(f"_n_{c}") > 1, F.raise_error(F.lit(f"several values of {c} in one night"))).otherwise(F.col(c)).alias(c) for c in columns]
    repeats = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    single = features.join(repeats, keys).withColumn(keys[-1], F.when(F.col("_rows") > 1, F.raise_error(F.lit("night occurs more than once"))).otherwise(F.col(keys[-1]))).drop("_rows")
    return single.join(once.select(*keys, *clash), keys, "left")


def resample_decisions(rates: DataFrame, key: str, data_hz: str, uniform: str, wanted: float | str | None = "infer", header_hz: str | None = None) -> DataFrame:
    """(key, resample, hz): whether a series is put on an even grid, and at which rate.

    ``wanted`` is a rate, ``infer`` (the multiple of ten near the data's rate, see
    :func:`.windows.target_rate`) or None.  A target that differs from the header's rate by over 10 %
    of it gives way to that rate.  Series of uneven steps are resampled unless nothing is wanted, even
    ones only where a rate is wanted that isn't the data's to within rounding (a part in 100,000).
    Without a target there is nothing to resample to.
    """
    data = F.col(data_hz)
    if wanted is None:
        return rates.select(key, F.lit(False).alias("resample"), data.cast("double").alias("hz"))
    infer = wanted == "infer"
    header = F.col(header_hz) if header_hz else F.lit(None).cast("double")
    target = target_rate(data) if infer else F.lit(float(wanted))
    target = F.when(F.abs(header - target) > 0.1 * header, header).otherwise(F.coalesce(target, header))
    near = F.lit(True) if infer else F.coalesce(F.abs(data - float(wanted)) <= 1e-8 + 1e-5 * abs(float(wanted)), F.lit(False))
    return rates.select(key, ((~F.col(uniform) | ~near) & target.isNotNull()).alias("resample"), target.alias("hz"))


def final_rate(rates: DataFrame, key: str, data_hz: str, header_hz: str) -> DataFrame:
    """(key, hz, differs): the rate of the data, else of the header; ``differs`` where both are known and unequal.

    A recording of which neither is known is an error when the rates are computed.
    """
    differs = F.coalesce(F.col(data_hz) != F.col(header_hz), F.lit(False))
    none = F.raise_error(F.concat(F.lit("no sample rate is known of "), F.col(key).cast("string"))).cast("double")
    hz = F.when(F.col(data_hz).isNull() & F.col(header_hz).isNull(), none).otherwise(F.coalesce(data_hz, header_hz))
    return rates.select(key, hz.alias("hz"), differs.alias("differs"))
