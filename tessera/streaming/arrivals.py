"""Structured Streaming over delivered measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Delivered measurement files as a stream. ``path``: a folder, or a pattern of folders or files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def layer_means(stream: DataFrame, value: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Number and mean of a channel per stack, layer and window of measuring time, each cell once, later ones dropped after ``late``.

    Deliveries of a cell carry the same measured_at, so the watermark also bounds the state that removes
    repeated deliveries.
    """
    once = stream.withColumn("measured_at", F.col("measured_at").cast("timestamp")).withWatermark("measured_at", late).dropDuplicates(["cell_id", "measured_at"])
    return once.groupBy(F.window("measured_at", window).alias("w"), "stack", "layer").agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("from"), "stack", "layer", "n", "mean")
