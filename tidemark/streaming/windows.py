"""Streaming forms of the window and session operators.

The same rules as the batch operators, over unbounded input: event time with a watermark, state
only for open windows and sessions.  Times are timestamps with zone here, as watermarks need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shared import new_path


def stationary_windows(stream: DataFrame, key: str, ts: str, axes: list[str], width: str = "10 seconds", late: str = "1 minute", limit: float = 0.015) -> DataFrame:
    """(key, window, n, std_<axis>, still): tumbling windows, given out once the watermark has passed them."""
    stats = [F.stddev_samp(a).alias(f"std_{a}") for a in axes]
    out = stream.withWatermark(ts, late).groupBy(key, F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), *stats)
    still = F.lit(True)
    for a in axes:
        still = still & F.coalesce(F.col(f"std_{a}") < limit, F.lit(False))
    return out.withColumn("still", still)


def sessions(stream: DataFrame, key: str, ts: str, gap: str, late: str = "1 minute", values: dict | None = None) -> DataFrame:
    """(key, start, end, n, ...): bouts of rows no more than ``gap`` apart.  Rows exactly a gap apart stay together."""
    out = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("s"))
    return out.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"), *[f.alias(n) for n, f in (values or {}).items()]).drop("s")


def read_table_stream(spark: SparkSession, path: str, ts: str) -> DataFrame:
    """A parquet table (a folder, or one file of it) as a stream, its time column with zone (taken as UTC)."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    source = spark.readStream.schema(schema)
    rows = source.option("pathGlobFilter", name).parquet(folder) if single else source.parquet(path)
    return rows.withColumn(ts, F.to_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def run_to_table(stream: DataFrame, tag: str, mode: str = "complete") -> DataFrame:
    """Run over all that is there now and return the last result; state and result lie in the shared folder."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, tag)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, f"{tag}-state")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
