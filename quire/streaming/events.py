"""File events as streams: settled files, deduplication, running statistics, upserts.

Event time is ``ts``; how late an event may come is a parameter (the watermark).
Each function takes a streaming or a batch frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(df: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark; times without a zone are taken as the session's (UTC)."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def unique_events(df: DataFrame, key: str = "event_id", time: str = "ts", late: str = "7 days") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    df = timed(df, time, late)
    return df.dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def settled(df: DataFrame, key: str = "file_path", time: str = "ts", quiet: str = "2 seconds", late: str = "7 days") -> DataFrame:
    """Bursts of events of a file that ended with ``quiet`` time without a further one."""
    df = timed(df, time, late)
    return df.groupBy(key, F.session_window(time, quiet).alias("burst")).agg(F.count("*").alias("events")).select(key, F.col("burst.start").alias("began"), F.col("burst.end").alias("settled_at"), "events")


def running_counts(df: DataFrame, kind: str = "event_kind", time: str = "ts", width: str = "1 day", late: str = "7 days") -> DataFrame:
    df = timed(df, time, late)
    return df.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.avg("file_size").alias("mean_size")).select(F.col("w.start").alias("day"), kind, "n", "mean_size")


def run_once(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet, and give the result."""
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def upsert_each(df: DataFrame, folder: str, target: str, key: str, time: str) -> None:
    """Keep the latest row of each key in ``target``; each batch writes a new version, named by its number."""
    spark = df.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        last = _version(spark, target, number - 1)
        rows = batch if last is None else batch.unionByName(last)
        latest = rows.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(time)).alias("v")).select("v.*")
        latest.write.mode("overwrite").parquet(f"{target}/v={number}")

    df.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def _version(spark: SparkSession, target: str, number: int) -> DataFrame | None:
    if number < 0:
        return None
    return spark.read.parquet(f"{target}/v={number}")


def stream_of(spark: SparkSession, path: str, files_each: int = 4) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)
