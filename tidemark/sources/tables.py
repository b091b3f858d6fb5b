"""Metadata and feature tables in, result tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cohort as C

from .devices import detect_delimiter


def read_metadata(spark: SparkSession, path: str, subject: str = "ID", record: str = "record_ID", filename: str = "filename") -> DataFrame:
    """A cohort's metadata: cells trimmed, exclusions canonical, summary rows dropped, record ids filled, names and keys unique."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(100).collect())
    rows = spark.read.csv(path, sep=detect_delimiter(head + "\n"), header=True)
    rows = rows.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in rows.columns])
    rows = C.drop_summary_rows(rows, [c for c in (filename, subject) if c in rows.columns], [])
    rows = rows.withColumn("exclude", C.exclude_flag("exclude") if "exclude" in rows.columns else F.lit("0"))
    if record not in rows.columns:
        rows = rows.withColumn(record, F.lit(None).cast("string"))
    rows = C.fill_record_ids(rows, subject, record, filename)
    for keys in ((filename,), (subject, record)):
        if bad := C.duplicates(rows.where(" and ".join(f"`{k}` is not null" for k in keys)), *keys).limit(5).collect():
            raise ValueError(f"{path}: repeated {keys}: {[tuple(b)[:-1] for b in bad]}")
    return rows.withColumn("record_key", C.record_key(subject, record))


def read_features(spark: SparkSession, path: str, required: list[str], subject: str = "id", record: str = "record_id") -> DataFrame:
    """Feature CSVs of a glob with their record keys; index columns go, missing columns are an error."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    rows = rows.drop(*[c for c in rows.columns if c.startswith("Unnamed") or c.startswith("_c")])
    if missing := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"{path}: columns are missing: {missing}")
    return rows.withColumn("record_key", C.record_key(subject, record)).withColumn("source_file", F.col("_metadata.file_path"))


def write_series(df: DataFrame, path: str, key: str = "recording_id") -> None:
    """Parquet by recording; a later read of some recordings reads only their folders."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def read_series(spark: SparkSession, path: str, recordings: list[str] | None = None, key: str = "recording_id") -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if recordings is None else rows.where(F.col(key).isin(recordings))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; the caller's partitioning is kept."""
    df.write.mode("overwrite").csv(path, header=True)


def info_json(df: DataFrame, name: str = "info") -> DataFrame:
    """Rows as JSON: NaN as null, times to the second."""
    cells = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = F.col(f.name)
        c = F.when(~F.isnan(c), c) if kind in ("double", "float") else F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind.startswith("timestamp") else c
        cells.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias(name))


def night_predictions(df: DataFrame, key: str = "id", night: str = "night", synthetic: str | None = None) -> DataFrame:
    """Evaluated real nights in their usual column order; synthetic rows and repeated nights are errors."""
    if synthetic and df.where(F.col(synthetic)).limit(1).collect():
        raise ValueError("synthetic rows among the predictions")
    if C.duplicates(df, key, night).limit(1).collect():
        raise ValueError("a night is predicted twice")
    first = [c for c in (key, night, "ground_truth", "prob", "pred") if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first and c != synthetic])


def patient_predictions(nights: DataFrame, key: str = "id", night: str = "night", prob: str = "prob") -> DataFrame:
    """(key, n_nights, nightly_probs): the nights' probabilities in order, comma-joined."""
    lists = F.transform(F.sort_array(F.collect_list(F.struct(night, prob))), lambda s: F.format_number(s[prob], 4))
    return nights.groupBy(key).agg(F.count(F.lit(1)).alias("n_nights"), F.concat_ws(",", lists).alias("nightly_probs"))
