"""Arriving files as a stream: batch operators on each micro-batch, and windowed counts with late data dropped by watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100, glob: str = "*.parquet") -> DataFrame:
    """New files of a folder. The checkpoint remembers which were read, so a restart goes on where it stopped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to each micro-batch and write it to a folder of the batch's number: a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], value: str, width: str, lateness: str) -> DataFrame:
    """Counts and sums per key and time window; events later than ``lateness`` behind the newest are dropped."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def appended(counts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Closed windows only, each once."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
