"""Readers of the stored points, cells and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INTERNAL = "_internal"


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def tag_columns(points: DataFrame) -> list[str]:
    """Names of a store's tags; its other columns are the time and fields."""
    return [f.name for f in points.schema.fields if f.metadata.get("tag")]


def scan_measurement(spark: SparkSession, path: str, measurement: str) -> DataFrame:
    """All points of one measurement; only its folder is read."""
    return read_points(spark, path).where(F.col("measurement") == measurement)


def list_measurements(points: DataFrame) -> DataFrame:
    """Measurements of a store with their size and span."""
    return (
        points.where(F.col("measurement") != INTERNAL)
        .groupBy(F.col("measurement").alias("name"))
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.min("time").alias("first_time"),
            F.max("time").alias("last_time"),
        )
    )


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_archive(spark: SparkSession, path: str, pattern: str = "part*") -> DataFrame:
    """Every archived (key, value), all segments in parallel."""
    return spark.read.option("pathGlobFilter", pattern).parquet(path)
