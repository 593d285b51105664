"""What leaves the engine: CSV with formatted numbers, cytometry files, metadata and files moved into project folders."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import folder_title
from .arrays import numeric_export


def general_format(value: Column, digits: int) -> Column:
    """A number with so many significant digits, as %g prints it: no trailing zeros, an exponent below -4 or from ``digits`` on.

    Null and NaN are the empty text. Halves are rounded away from zero.
    """
    v = value.cast("double")
    shown = F.format_string(f"%.{digits - 1}e", v)
    power = F.regexp_extract(shown, r"e([+-]\d+)$", 1).cast("int")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fixed = F.lit(None).cast("string")
    for p in range(-4, digits):
        fixed = F.when(power == p, F.format_string(f"%.{digits - 1 - p}f", v)).otherwise(fixed)
    far = F.concat(bare(F.regexp_extract(shown, r"^(.*)e", 1)), F.lit("e"), F.regexp_extract(shown, r"e([+-]\d+)$", 1))
    text = F.when((power >= -4) & (power < digits), F.when(fixed.contains("."), bare(fixed)).otherwise(fixed)).otherwise(far)
    return F.when(v.isNull() | F.isnan(v), "").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).when(v == 0, "0").otherwise(text)


def write_csv(df: DataFrame, path: str, digits: int | None = None, mode: str = "overwrite") -> None:
    """A folder of CSV files with headers; ``digits`` formats the columns of fractions, other columns stay as they are."""
    if digits is not None:
        df = df.select(*(general_format(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() in ("float", "double") else F.col(f.name) for f in df.schema.fields))
    df.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def encode_fcs(names: list[str], rows: np.ndarray) -> bytes:
    """Events as an FCS 3.1 file: a header, keywords, and the values as little-endian 32-bit floats, event by event."""
    data = np.ascontiguousarray(rows, "<f4").tobytes()
    top = [float(rows[:, k].max()) if len(rows) else 1.0 for k in range(len(names))]
    keys = {"$BYTEORD": "1,2,3,4", "$DATATYPE": "F", "$MODE": "L", "$NEXTDATA": "0", "$PAR": str(len(names)), "$TOT": str(len(rows)), "$BEGINANALYSIS": "0", "$ENDANALYSIS": "0", "$BEGINSTEXT": "0", "$ENDSTEXT": "0"}
    for k, (name, most) in enumerate(zip(names, top, strict=True), 1):
        keys |= {f"$P{k}N": name, f"$P{k}B": "32", f"$P{k}E": "0,0", f"$P{k}R": str(max(1, int(np.ceil(most)) if np.isfinite(most) else 1))}
    text = lambda a, b: ("/" + "/".join(f"{k}/{str(v).replace('/', '//')}" for k, v in (keys | {"$BEGINDATA": f"{a:020d}", "$ENDDATA": f"{b:020d}"}).items()) + "/").encode()
    start = 58 + len(text(0, 0))
    end = start + len(data) - 1
    place = lambda n: f"{n if n <= 99_999_999 else 0:>8}"
    return f"FCS3.1    {place(58)}{place(start - 1)}{place(start)}{place(end)}{place(0)}{place(0)}".encode() + text(start, end) + data


def decode_fcs(content: bytes) -> tuple[list[str], np.ndarray]:
    """Names and values of a file that encode_fcs() wrote."""
    a, b = int(content[10:18]), int(content[18:26])
    parts = content[a + 1 : b].decode().replace("//", "\0").split("/")
    keys = {k: v.replace("\0", "/") for k, v in zip(parts[::2], parts[1::2], strict=True)}
    n, m = int(keys["$PAR"]), int(keys["$TOT"])
    start = int(keys["$BEGINDATA"])
    return [keys[f"$P{k}N"] for k in range(1, n + 1)], np.frombuffer(content[start : start + 4 * n * m], "<f4").reshape(m, n)


def fcs_files(metrics: DataFrame, by: str = "image_id", label: str = "label") -> DataFrame:
    """Rows (by, data): each image's objects, by label, as one cytometry file of their numeric columns."""
    clean = numeric_export(metrics.drop(by), label)
    names = clean.columns
    both = metrics.select(by, *(F.col(c) for c in names if c == label), *(c.alias(n) for n, c in ((n, _finite(n)) for n in names if n != label)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(label, kind="stable")
        return pd.DataFrame({by: [pdf[by].iloc[0]], "data": [encode_fcs(names, pdf[names].to_numpy(np.float64))]})

    return both.groupBy(by).applyInPandas(run, f"`{by}` {metrics.schema[by].dataType.simpleString()}, data binary")


def _finite(name: str) -> Column:
    from ..functions.columns import finite_or_zero

    return finite_or_zero(F.col(name))


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file in any store that Spark writes to; an older one is replaced."""
    at, system = _file_system(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_files(files: DataFrame, path: str = "path", data: str = "data") -> int:
    """Writes a file for each row, one after the other through the driver, and says how many: for results of few images."""
    n = 0
    for row in files.select(path, data).toLocalIterator():
        write_bytes(files.sparkSession, row[0], bytes(row[1]))
        n += 1
    return n


def move_files(plan: DataFrame, source: str = "path", folder: str = "folder") -> list[tuple[str, str]]:
    """Moves each file of a plan (as project.organise() gives) into its folder; returns (from, to). A plan is a row an image.

    A file that is gone already, or whose target exists, is passed over, so that a run that broke off can be repeated.
    """
    spark, done = plan.sparkSession, []
    for row in plan.select(source, folder).toLocalIterator():
        at, system = _file_system(spark, row[0])
        to = spark._jvm.org.apache.hadoop.fs.Path(row[1], at.getName())
        if system.exists(at) and not system.exists(to):
            system.mkdirs(to.getParent())
            if system.rename(at, to):
                done.append((row[0], to.toString()))
    return done


def write_image_config(spark: SparkSession, path: str, mode: str, sizes: dict[str, float]) -> None:
    """An image's YAML: its mode and its physical size by axis (pixel_dimensions in 2D, voxel_dimensions in 3D)."""
    write_bytes(spark, path, yaml.safe_dump({"mode": mode, ("voxel" if mode == "3d" else "pixel") + "_dimensions": sizes}, sort_keys=False).encode())


def write_interaction_metadata(spark: SparkSession, path: str, primary: str, reference: str, metrics: str, coverage: str) -> None:
    """A YAML with the four paths that an interaction run used and made."""
    write_bytes(spark, path, yaml.safe_dump({"primary_segmentation": primary, "reference_segmentation": reference, "interaction_metrics": metrics, "reference_coverage": coverage}, sort_keys=False).encode())


def presets(files: DataFrame) -> DataFrame:
    """Rows (path, title) of the YAML files in a listing, by title."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.where(F.lower(name).rlike(r"\.ya?ml$")).select("path", folder_title(name).alias("title")).orderBy("title", "path")
