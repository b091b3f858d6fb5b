"""The cohort matrix: from reconciled feature tables to one vector a movement, night or patient.

Everything is keyed by ``record_key`` (patient and record), so two records of a patient never mix their
nights.  Metadata come from one table, a row a record, with the label and the side of the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import nights as N
from .cohort import reconcile, record_key
from .learning import feature_names
from .selection import keep_durations

#: The aggregates of a night, in the order of the matrix.
AGGREGATES = ("mean", "std", "skew", "kurt", "mad", "iqr", "p10", "p90")
LEVELS = ("move", "night", "patient")


def keyed(df: DataFrame, subject: str = "id", record: str = "record_id") -> DataFrame:
    """``df`` with record_key; rows without a subject are an error when computed."""
    named = F.when(F.col(subject).isNull(), F.raise_error(F.lit("row without a subject")).cast("string")).otherwise(record_key(subject, record))
    return df.withColumn("record_key", named)


def checked(metadata: DataFrame) -> DataFrame:
    """(record_key, id, y, side): one row a record; two rows of a record, a label that isn't 0 or 1, or a patient with two labels is an error when computed."""
    rows = keyed(metadata).select("record_key", F.col("id").cast("string").alias("id"), F.col("ground_truth").cast("int").alias("y"), F.col("side"))
    once = rows.groupBy("record_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("y").alias("y"), F.min("side").alias("side"))
    patients = once.groupBy("id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))

    def wrong(condition: Column, said: str) -> Column:
        return F.when(condition, F.raise_error(F.concat(F.lit(f"{said}: "), F.col("record_key"))).cast("int"))

    label = F.coalesce(wrong(F.col("n") > 1, "record occurs twice"), wrong(~F.coalesce(F.col("y").isin(0, 1), F.lit(False)), "label is not 0 or 1"), wrong(F.col("lo") != F.col("hi"), "patient has two labels"), F.col("y"))
    return once.join(patients, "id").select("record_key", "id", label.alias("ground_truth"), "side")


def gaps(features: DataFrame, metadata: DataFrame) -> DataFrame:
    """(record_key, status): records that only the metadata or only the features have."""
    return reconcile(keyed(metadata), keyed(features), "record_key").where("status <> 'both'")


def cohort_matrix(
    local: DataFrame, global_: DataFrame | None, metadata: DataFrame, level: str, local_features: list[str], global_features: list[str] = (), *, order: str = "aggregate",
    longest: bool = True,
) -> DataFrame:
    """(id, record_key[, night], ground_truth, side, the features): the matrix of a level, one plan of joins and aggregates.

    ``move`` has a row for each movement of ``local`` and its own features; ``night`` eight
    aggregates of each local feature, feature by feature or ``aggregate`` by aggregate, and the
    night's features of ``global_``; ``patient`` the means of a patient's nights, with the first
    of its record keys and that record's side.  Movements outside 0.5 to 50 s are left out (with
    ``longest``), and so are records without metadata; a night without global features has nulls there.
    ``local`` and ``global_`` have (id, record_id, night).
    """
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    about = checked(metadata)
    rows = keyed(local)
    rows = keep_durations(rows, "time_diff") if longest else rows
    if level == "move":
        moves = rows.select("record_key", "night", *local_features)
        return moves.join(about, "record_key").select("id", "record_key", "night", "ground_truth", "side", *local_features)
    keys = ["record_key", "night"]
    night = N.eight_statistics(rows.select(*keys, *local_features), keys, list(local_features))
    if global_features:
        extra = keyed(global_).groupBy(*keys).agg(*[F.min(g).alias(g) for g in global_features], F.count(F.lit(1)).alias("_rows"))
        first = global_features[0]
        once = F.when(F.col("_rows") > 1, F.raise_error(F.concat(F.lit("night occurs more than once: "), F.col("record_key"))).cast(extra.schema[first].dataType)).otherwise(F.col(first))
        night = night.join(extra.withColumn(first, once).drop("_rows"), keys, "left")
    names = feature_names(list(local_features), list(AGGREGATES), list(global_features), order)
    night = night.join(about, "record_key").select("id", *keys, "ground_truth", "side", *names)
    if level == "night":
        return night
    means = night.groupBy("id").agg(F.min(F.struct("record_key", "side")).alias("first"), F.min("ground_truth").alias("ground_truth"), *[F.avg(n).alias(n) for n in names])
    return means.select("id", F.col("first.record_key").alias("record_key"), "ground_truth", F.col("first.side").alias("side"), *names)


def complete(matrix: DataFrame, features: list[str]) -> DataFrame:
    """(side, rows, incomplete): how many rows of each side lack a feature or have one that is no number."""
    bad = F.lit(False)
    for f in features:
        bad = bad | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    return matrix.groupBy("side").agg(F.count(F.lit(1)).alias("rows"), F.sum(bad.cast("long")).alias("incomplete"))
