"""Streams: event-time windows with watermarks, sessions, keyed latest values, deduplication, chunk callbacks."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kolumna.session import shared_folder


def source(spark: SparkSession, path: str, like: DataFrame, glob: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    """A Parquet file stream with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", glob).parquet(path)


def event_time(df: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Watermarked; a time without zone is taken in the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], **aggregates: Column) -> DataFrame:
    out = df.groupBy(F.window(ts, size), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("window.start").alias("start"), *by, *aggregates)


def sliding(df: DataFrame, ts: str, size: str, slide: str, by: list[str], **aggregates: Column) -> DataFrame:
    out = df.groupBy(F.window(ts, size, slide), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("window.start").alias("start"), *by, *aggregates)


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], **aggregates: Column) -> DataFrame:
    out = df.groupBy(F.session_window(ts, gap), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *aggregates)


def latest(df: DataFrame, by: list[str], ts: str, *values: str) -> DataFrame:
    """Keyed upsert: the newest row per key (update mode)."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*values), F.col(ts)).alias("__v")).select(*by, "__v.*")


def deduplicated(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(list(keys))


def run_to_table(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now, into files of the shared folder, and give them as a table.

    No row passes through the driver. mode: complete (the rows of the last batch) or append (those of all batches).
    """
    if mode not in ("complete", "append"):
        raise ValueError("mode is complete or append")
    spark, schema = df.sparkSession, df.schema
    folder = f"{shared_folder(spark)}/stream-{os.urandom(6).hex()}"
    done: dict[int, str] = {}

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{folder}/rows/{number}"
        batch.write.mode("overwrite").parquet(path)
        if mode == "complete":
            for old in done.values():
                if old != path:
                    p = spark._jvm.org.apache.hadoop.fs.Path(old)
                    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            done.clear()
        done[number] = path

    for_each_chunk(df, keep, f"{folder}/journal", mode=mode).awaitTermination()
    return spark.read.schema(schema).parquet(*done.values()) if done else spark.createDataFrame([], schema)


def for_each_chunk(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append"):
    """A callback per micro-batch; offsets in the checkpoint make it a replayable journal."""
    w = df.writeStream.foreachBatch(f).outputMode(mode).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
