"""Trajectories: which steps are written, Parquet sinks partitioned by run, and readers of step ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def once(steps: DataFrame) -> DataFrame:
    """Step 0 alone."""
    return steps.where("step = 0").withColumn("slot", F.lit(0).cast("long"))


def every(steps: DataFrame, n: int) -> DataFrame:
    """Steps 0, n, 2 n, ... with their slot."""
    return steps.where(F.pmod("step", F.lit(n)) == 0).withColumn("slot", F.floor(F.col("step") / n))


def slots(total: int, n: int) -> int:
    return -(-total // n)


def write(steps: DataFrame, path: str, run: str, group: str, frequency: int | None = None) -> None:
    """Appends the logged steps of a run's group; ``frequency`` None writes step 0 alone."""
    logged = once(steps) if frequency is None else every(steps, frequency)
    logged.withColumn("run", F.lit(run)).withColumn("group", F.lit(group)).write.mode("append").partitionBy("run", "group").parquet(path)


def read(spark: SparkSession, path: str, run: str, group: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Slots start to stop of a run's group; only that partition is read, and the slot filter reaches the scan."""
    df = spark.read.parquet(path).where((F.col("run") == run) & (F.col("group") == group)).drop("run", "group")
    if start is not None:
        df = df.where(F.col("slot") >= start)
    return df if stop is None else df.where(F.col("slot") < stop)


def groups(spark: SparkSession, path: str, run: str) -> list[str]:
    return [r.group for r in spark.read.parquet(path).where(F.col("run") == run).select("group").distinct().orderBy("group").collect()]


def serialise(df: DataFrame, name: str = "data") -> DataFrame:
    """Rows as JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def deserialise(df: DataFrame, schema: str, name: str = "data") -> DataFrame:
    return df.select(F.from_json(name, schema).alias("_x")).select("_x.*")
