"""Structured Streaming over trajectory files: running statistics, acceptance tuning, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.tuning import STATE, WIDTHS, stream_tuner


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """New Parquet files of a trajectory folder, a bounded number for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_means(steps: DataFrame, value: str, block: int) -> DataFrame:
    """Mean, count and largest value of each block of steps of each system."""
    return steps.groupBy("system_id", F.floor(F.col("step") / block).alias("block")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.max(value).alias("largest"))


def windowed_means(events: DataFrame, time: str, value: str, window: str, late: str) -> DataFrame:
    """Means over windows of event time; rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "system_id").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def tuned_stream(outcomes: DataFrame, length: int = 100, value: float = 1.0) -> DataFrame:
    """Step widths by acceptance tuning, kept as state of each system."""
    rows = outcomes.select("system_id", "step", "acceptance")
    return rows.groupBy("system_id").applyInPandasWithState(stream_tuner(length, value), WIDTHS, STATE, "append", "NoTimeout")


def to_tables(steps: DataFrame, sinks: dict[str, str], checkpoint: str) -> StreamingQuery:
    """Writes each batch to several folders: name of a column list or * -> path."""
    def write(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        for columns, path in sinks.items():
            kept.selectExpr(*columns.split(",")).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)
        kept.unpersist()

    return steps.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
