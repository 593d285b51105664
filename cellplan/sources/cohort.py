"""Cohorts of measured images: many metric files as one table, and multi-channel projects as plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohort import attach_groups, union_cohorts


def load_dataset(spark: SparkSession, tag: str, path: str, schema: str, pattern: str = r"([^/]+)/[^/]+/[^/]+$", groups: DataFrame | None = None, derive: Callable[[Column], Column] | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Cells of all metric CSV files that a glob names: the columns, Image_ID_Full, Dataset_Tag, Experimental_Group, Batch.

    The image is what ``pattern`` finds in a file's path, by default its folder's parent. ``keep`` tells by the path which
    files belong; ``derive`` gives a group from the image where none is assigned. Empty files give no rows; a path
    without files fails in Spark's reader.
    """
    cells = spark.read.schema(schema).option("header", True).csv(path).withColumn("_path", F.col("_metadata.file_path"))
    if keep is not None:
        cells = cells.where(keep(F.col("_path")))
    cells = cells.withColumn("Image_ID_Full", F.regexp_extract("_path", pattern, 1)).drop("_path").withColumn("Dataset_Tag", F.lit(tag))
    if derive is not None:
        cells = cells.withColumn("Experimental_Group", derive(F.col("Image_ID_Full")))
    none = spark.createDataFrame([], "Image_ID string, Experimental_Group string, Batch string")
    return attach_groups(cells, groups if groups is not None else none, "Image_ID_Full", tag)


def load_cohort(*datasets: DataFrame) -> DataFrame:
    return union_cohorts(*datasets)


def channel_plan(files: DataFrame, channels: int) -> DataFrame:
    """Rows (channel, Filename, path, Width (um), Height (um), Depth (um), Slices) for every channel that a file has.

    files: (path, n_channels, nz, ny, nx, sz, sy, sx). Sizes are scale times pixels; a file with too few channels is left
    out for the channels that it lacks.
    """
    each = files.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1)))).where(F.col("channel") < F.col("n_channels"))
    return each.select("channel", F.regexp_extract("path", "([^/]*)$", 1).alias("Filename"), "path", (F.col("sx") * F.col("nx")).alias("Width (um)"), (F.col("sy") * F.col("ny")).alias("Height (um)"), (F.col("sz") * F.col("nz")).alias("Depth (um)"), F.col("nz").alias("Slices"))


def with_dimension_key(configs: DataFrame, key: str) -> DataFrame:
    """Of (path, content) of YAML files the folders whose configuration has the key at its top level."""
    return configs.where(F.col("content").cast("string").rlike(rf"(?m)^{key}\s*:")).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
