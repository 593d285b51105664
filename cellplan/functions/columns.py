"""Scalar functions on columns: names, labels, patterns, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a file name may end in, taken off when names are compared. Fixed values.
EXTENSIONS = ("tiff?", "czi", "lif", "nd2", "ome", "yaml", "csv")


def natural_key(name: Column) -> Column:
    """A string by which names sort with their numbers in numeric order: digits are padded, letters in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})", "$1")


def ordinal_group(image_id: Column, prefix: str = "iba1-", otherwise: str = "2D_Other") -> Column:
    """The ordinal number (as 5th) that follows the prefix, or the fallback."""
    found = F.regexp_extract(image_id, prefix + r"(\d+(?:st|nd|rd|th))", 1)
    return F.when(found == "", otherwise).otherwise(found)


def clean_name(name: Column) -> Column:
    """Lower case, without known extensions (however many) and without a trailing scene number such as ' #2'."""
    tails = "(?:" + "|".join(EXTENSIONS) + ")"
    plain = F.regexp_replace(F.lower(F.trim(name)), r"\s+#\d+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"(?:\.{tails})+$", ""), r"\s+#\d+$", ""))


def axis_label(metric: Column) -> Column:
    """A metric's name as text: words capitalised, um, um2 and um3 as units."""
    return F.array_join(F.transform(F.split(metric, "_"), lambda w: F.when(w == "um", "µm").when(w == "um2", "µm²").when(w == "um3", "µm³").otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))), " ")


def significance(p: Column) -> Column:
    return F.when(p.isNull(), "n.s.").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def p_text(p: Column) -> Column:
    return F.when(p.isNull(), "n.a.").when(p < 0.001, "p<0.001").otherwise(F.format_string("p=%.3f", p))


def folder_title(name: Column) -> Column:
    """A preset's file name as a title."""
    return F.initcap(F.regexp_replace(F.regexp_replace(name, r"\.ya?ml$", ""), "[_-]+", " "))


def pixel_size(unit_code: Column, unit: Column, density: Column) -> Column:
    """Micrometres per pixel from a TIFF's resolution: 3 per centimetre, 2 per inch; else by the unit's name.

    Without a unit a density below 1 is taken for the size itself.
    """
    per = F.try_divide
    return F.when(unit_code == 3, per(F.lit(10000.0), density)).when(F.lower(unit).isin("micron", "um", "µm", "\\u00b5m"), per(F.lit(1.0), density)).when(unit_code == 2, per(F.lit(25400.0), density)).when(density < 1, density).otherwise(per(F.lit(1.0), density))


def ome_channels(xml: Column) -> Column:
    return F.regexp_extract(xml, r'SizeC="(\d+)"', 1).try_cast("int")


def channel_count(description: Column, shape: Column) -> Column:
    """Channels of an image: by its ImageJ description, else by its OME one, else by its shape (an array of sizes).

    An ImageJ description without a count has one channel. Of three sizes the first counts if it is below 10 and below the
    second, of four the lesser of the first two; all else is one channel.
    """
    named = F.regexp_extract(description, r"(?m)^channels=(\d+)", 1).try_cast("int")
    first, second = F.get(shape, 0), F.get(shape, 1)
    by_shape = F.when((F.size(shape) == 3) & (first < 10) & (first < second), first).when(F.size(shape) == 4, F.least(first, second)).otherwise(1)
    return F.coalesce(F.when(description.startswith("ImageJ="), F.coalesce(named, F.lit(1))), F.when(F.size(shape) >= 0, F.coalesce(ome_channels(description), by_shape)), F.lit(1)).cast("int")


def ome_size(xml: Column, axis: str) -> Column:
    return F.regexp_extract(xml, rf'PhysicalSize{axis}="([0-9.eE+-]+)"', 1).try_cast("double")


def czi_scaling(xml: Column) -> Column:
    """Micrometres per pixel by axis from a CZI's metadata: map of X, Y, Z."""
    ids = F.regexp_extract_all(xml, F.lit(r'<Distance[^>]*Id="(\w)"'), F.lit(1))
    values = F.transform(F.regexp_extract_all(xml, F.lit(r'<Distance[^>]*Id="\w"[^>]*>\s*<Value>([^<]*)</Value>'), F.lit(1)), lambda v: v.try_cast("double") * 1e6)
    return F.map_from_arrays(ids, values)


def spacing(total_um: Column, pixels: Column) -> Column:
    """Physical size of a voxel along an axis; a missing total counts as 1 micrometre."""
    return F.try_divide(F.coalesce(total_um, F.lit(1.0)), pixels)


def finite_or_zero(value: Column) -> Column:
    """What an export without undefined numbers holds: 0 for null, NaN and infinities."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
