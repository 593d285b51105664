"""Trimming of artifacts at the edge of the tissue: the hull of the tissue, and what is deleted near its border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import levels, raster
from .raster import AXES


def hull(intensity: DataFrame, cells: DataFrame, value: str = "intensity", closing_radius: int = 10, factor: int = 4, least: int = 100, dims: int = 2) -> DataFrame:
    """The tissue's mask (z, y, x): bright or labelled voxels, coarsened, cleaned, closed slice by slice, the largest part.

    intensity must cover the whole raster. Parts below ``least`` coarse pixels go before the closing; holes are filled
    after the largest part is known in 2D and before in 3D.
    """
    level = levels.log_otsu_hull_level(intensity, value)
    bright = intensity.join(F.broadcast(level)).where(F.col(value) > F.col("threshold"))  # one row
    coarse = raster.downsample(raster.mask_or(bright, cells), factor, dims)
    domain = raster.downsample(intensity.select(*AXES), factor, dims)
    per_slice = raster.components(raster.numbered(coarse))
    kept = raster.size_filter(per_slice, least, by=("z",)).select(*AXES)
    closed = raster.close_gaps(raster.dilate(kept, raster.ball(3)), raster.ball(closing_radius)).join(domain, list(AXES), "left_semi")

    def largest(mask):
        return raster.largest_component(raster.components(raster.numbered(mask), dims=dims)).select(*AXES)

    def filled(mask):
        return raster.mask_or(mask, raster.hole_voxels(mask, raster.numbered(domain)))

    out = filled(largest(closed)) if dims == 2 else largest(filled(closed))
    return raster.upsample(out, factor).join(intensity.select(*AXES), list(AXES), "left_semi")


def boundary(mask: DataFrame, dims: int = 2) -> DataFrame:
    """The mask less its erosion: by a box in 3D, by the rank-1 neighbourhood in 2D."""
    return raster.mask_minus(mask, raster.erode(mask, raster.box(1, 3) if dims == 3 else raster.cross()))


def trim(labels: DataFrame, intensity: DataFrame, threshold: float, distance: float, brightness_factor: float, least_size: int, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), value: str = "intensity", closing_radius: int = 10, z_erosion: int = 0, dims: int = 2) -> tuple[DataFrame, DataFrame]:
    """Trimmed labels (columns as given, voxels or whole objects less) and the hull's boundary.

    labels: (z, y, x, label). The threshold is an input in 2D and 3D alike. A distance of 0 leaves the edges alone;
    object sizes are judged over the whole image.
    """
    if z_erosion and dims == 3:
        kept = raster.clamped_z_erosion(labels, z_erosion, ("label",))
        labels = labels.join(kept, ["label", *AXES], "left_semi")
    if distance > 0:
        labels = raster.zero_edge_trim(labels, intensity, distance, spacing, value=value, dims=dims)
    tissue = hull(intensity, labels, value, closing_radius, dims=dims)
    if distance > 0:
        top = levels.otsu(intensity, value).crossJoin(intensity.agg(F.max(value).alias("highest")))  # one row each
        cutoff = top.select(levels.reference_threshold(F.col("threshold"), F.lit(threshold), F.col("highest"), brightness_factor).alias("_cutoff"))
        bright = intensity.join(F.broadcast(cutoff)).where(F.col(value) > F.col("_cutoff")).select(*AXES)
        outside = intensity.select(*AXES).join(tissue, list(AXES), "left_anti")
        step = spacing[0] if dims == 3 else (spacing[1] + spacing[2]) / 2
        labels = raster.edge_trim(labels, outside, bright, distance, raster.core_iterations(step), spacing, dims)
    return raster.size_filter(labels, least_size), boundary(tissue, dims)
