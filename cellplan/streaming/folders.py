"""A folder of images as a stream: what arrives is measured once, instead of a loop that looks for what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import VOXELS


def voxel_stream(spark: SparkSession, path: str, schema: str = VOXELS, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def measured(voxels: DataFrame, threshold: float) -> DataFrame:
    """Running totals per image and channel: foreground voxels, their mean and their greatest intensity."""
    return voxels.where(F.col("intensity") > threshold).groupBy("image_id", "channel").agg(F.count("*").alias("voxels"), F.avg("intensity").alias("mean_intensity"), F.max("intensity").alias("max_intensity"))


def process_arrivals(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Gives every batch of new files to ``handle`` and stops when there are no more; a later call takes up where this ended."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
