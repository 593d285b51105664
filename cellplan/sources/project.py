"""Projects of images on a file system: which folders are complete, how tables and files go together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_name, natural_key
from ..operators.cohort import fuzzy_match


def listing(spark, root: str) -> DataFrame:
    """Files below root: (path, length), without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def valid_folders(files: DataFrame) -> DataFrame:
    """Folders that hold exactly one TIFF and one YAML file."""
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    counts = files.select(folder.alias("folder"), name.alias("n")).groupBy("folder").agg(F.count_if(F.col("n").rlike(r"\.tiff?$")).alias("t"), F.count_if(F.col("n").rlike(r"\.ya?ml$")).alias("y"))
    return counts.where("t = 1 and y = 1").select("folder")


def organise(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """A plan of moves (name, path, folder): each metadata row's file, by equal name or else by containment.

    Nothing is moved here; the folder is the file's name without its extension, below the file's own folder.
    """
    file = F.regexp_extract("path", "([^/]*)$", 1)
    named = files.withColumn("file", clean_name(file))
    found = fuzzy_match(metadata, named, clean_name(F.col("Filename")), F.col("file"))
    paths = named.groupBy("file").agg(F.min_by("path", natural_key(F.col("path"))).alias("path"))
    base = metadata.withColumn("wanted", clean_name(F.col("Filename")))
    return base.join(found, "wanted").join(paths, "file").select("Filename", "path", F.regexp_replace("path", r"\.[^./]*$", "").alias("folder"))


def interaction_reference(primary: DataFrame, references: DataFrame) -> DataFrame:
    """Each image's reference mask: the first by name among the final ones of the same image."""
    pick = references.where(F.col("artifact").startswith("final_segmentation")).groupBy("image_id").agg(F.min("path").alias("reference_path"))
    return primary.join(pick, "image_id", "left")


def channel(voxels: DataFrame, number: int) -> DataFrame:
    return voxels.where(F.col("channel") == number)
