"""Gridded rows that keep arriving along time: an addition, as gridded datasets themselves are bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def chunk_stream(spark: SparkSession, place: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet chunk files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(place)


def windowed_mean(stream: DataFrame, value: str, by: list[str], time: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Mean and count by cell and tumbling or sliding window; rows later than the watermark are dropped."""
    stamped = stream.withColumn(time, F.col(time).cast("timestamp_ltz")).withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stamped.groupBy(window.alias("window"), *by).agg(F.avg(value).alias(value), F.count("*").alias("n"))


def session_counts(stream: DataFrame, by: list[str], time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Rows by cell and session: a stretch without a gap."""
    stamped = stream.withColumn(time, F.col(time).cast("timestamp_ltz")).withWatermark(time, late)
    return stamped.groupBy(F.session_window(time, gap).alias("session"), *by).agg(F.count("*").alias("n"))
