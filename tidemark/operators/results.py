"""What cross-validation leaves behind: score tables, chosen settings and features, seeds, run logs.

Tables of folds are small; they are aggregated like any other.  Empty tables give empty summaries,
null scores are left out of means, repeated rows count each.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import struct

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def seed_schedule(seed: int, repeats: int, folds: int) -> dict[int, list[int]]:
    """Outer seeds, one a repeat, each with an inner seed for every fold; no seed occurs twice.

    A seed is 31 bits of a hash of what it is for, drawn again where it was drawn before.  More
    repeats or folds leave the earlier repeats' outer seeds as they are, but for such draws.
    """
    taken: set[int] = set()

    def draw(*use: int) -> int:
        for attempt in itertools.count():
            words = struct.pack(f"<{len(use) + 2}q", seed, attempt, *use)
            value = int.from_bytes(hashlib.blake2b(words, digest_size=4).digest(), "little") >> 1
            if value not in taken:
                taken.add(value)
                return value

    outer = [draw(r) for r in range(repeats)]
    return {s: [draw(r, f) for f in range(folds)] for r, s in enumerate(outer)}


def format_setting(setting: dict, space: dict[str, list], decimals: int = 4) -> dict:
    """``setting`` in the types of its ``space``: whole numbers rounded, fractions to ``decimals``, other values among those allowed."""
    out = dict(setting)
    for name, allowed in space.items():
        if name not in out:
            continue
        if all(isinstance(v, int) and not isinstance(v, bool) for v in allowed):
            out[name] = round(out[name])
        elif all(isinstance(v, int | float) and not isinstance(v, bool) for v in allowed):
            out[name] = round(float(out[name]), decimals)
        elif out[name] not in allowed:
            raise ValueError(f"{out[name]} is no value of {name}")
    return out


def score_summary(folds: DataFrame, metrics: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, metric, mean, sd, n): mean and population deviation over the folds."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    long = folds.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.metric", "c.v")
    return long.groupBy(*keys, "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n"))


def selection_frequency(folds: DataFrame, features: str) -> DataFrame:
    """(feature, n, share): in how many of the folds each feature of the array column was chosen."""
    chosen = folds.select(F.explode(F.array_distinct(features)).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    total = folds.agg(F.count(F.lit(1)).alias("folds"))
    return chosen.crossJoin(F.broadcast(total)).select("feature", "n", (F.col("n") / F.col("folds")).alias("share"))  # one row


def best_folds(folds: DataFrame, score: str, order: str, share: float | None = None) -> DataFrame:
    """The fold of the highest score, or the highest ``share`` of the folds (at least one); ties by ``order``."""
    n = 1 if share is None else max(1, math.ceil(share * folds.count()))
    return folds.orderBy(F.desc_nulls_last(score), order).limit(n)  # the feature is a top n of a table of folds


def leave_one_out_summary(folds: DataFrame, dataset: str, metrics: list[str]) -> DataFrame:
    """(dataset, metrics): the means of each data set left out, and of all of them under ``all``."""
    each = folds.groupBy(F.col(dataset).cast("string").alias(dataset)).agg(*[F.avg(m).alias(m) for m in metrics])
    return each.union(each.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit("all"), *metrics))


def log_run(spark: SparkSession, path: str, run: str, status: str, **fields) -> None:
    """Append a line to a run log: who ran when, with what state; a lost writer leaves the earlier lines."""
    row = spark.range(1).select(F.lit(run).alias("run"), F.lit(status).alias("status"), F.current_timestamp().alias("at"), F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()] or [F.lit("").alias("note")])).alias("fields"))
    row.write.mode("append").parquet(path)


def last_states(log: DataFrame) -> DataFrame:
    """(run, status, at, fields): the last line of each run of a log; of lines at one time the greatest status."""
    last = log.groupBy("run").agg(F.max(F.struct("at", "status", "fields")).alias("x"))
    return last.select("run", "x.status", "x.at", "x.fields")


def save_model(model: PipelineModel, path: str, spark: SparkSession) -> None:
    """Write a fitted model; an older one at ``path`` is kept at ``path``.back, in place of the one before it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    here, back = jpath(path), jpath(path.rstrip("/") + ".back")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here):
        fs.delete(back, True)
        if not fs.rename(here, back):
            raise OSError(f"cannot move {path} aside")
    model.write().save(path)
