"""Windows over event time that run alike on a table and on a stream, and per-row stages as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as an instant, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(df: DataFrame, size: str, late: str = "0 seconds", column: str = "ts") -> DataFrame:
    """Count and sum of each event type per window; rows later than `late` are dropped on a stream."""
    rows = event_time(df, column)
    rows = rows.withWatermark(column, late) if rows.isStreaming else rows
    g = rows.groupBy(F.window(column, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.unix_timestamp(F.col("w.start")).alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


def sessions(df: DataFrame, gap: str, late: str = "0 seconds", column: str = "ts") -> DataFrame:
    """(user_id, session_start, n): a user's events with less than `gap` between neighbours."""
    rows = event_time(df, column)
    rows = rows.withWatermark(column, late) if rows.isStreaming else rows
    g = rows.groupBy(F.session_window(column, gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_timestamp(F.col("w.start")).alias("session_start"), "n")


def first_seen(df: DataFrame, key: str, column: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key; on a stream within the watermark, so that state stays bounded."""
    return df.withWatermark(column, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def run_available(spark: SparkSession, path: str, like: DataFrame, fn: Callable[[DataFrame], DataFrame], out: str, mode: str = "complete") -> DataFrame:
    """Apply `fn` to the files of a folder as a stream until none is left; gives the last state of its result.

    Complete results replace what is there batch by batch; append results add to it; a restart goes on from the
    checkpoint beside them.
    """
    stream = fn(spark.readStream.schema(like.schema).parquet(path))

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/rows")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
