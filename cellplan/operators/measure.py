"""Measurements of labelled objects: one row per object, all by plain aggregation. ``by`` holds the label (and image)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged
from .pairs import all_distances
from .raster import AXES, exposed_faces, surface

Spacing = tuple[float, float, float]
LABEL = ("label",)


def size(labels: DataFrame, spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = LABEL, dims: int = 3) -> DataFrame:
    """Voxel count and volume (3D) or pixel count and area (2D), in physical units."""
    unit = math.prod(spacing[3 - dims :])
    count, extent = ("voxel_count", "volume_um3") if dims == 3 else ("pixel_count", "area_um2")
    return labels.groupBy(*by).agg(F.count("*").alias(count), (F.count("*") * F.lit(unit)).alias(extent))


def shape_3d(labels: DataFrame, spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = LABEL, face_weights: str = "reference") -> DataFrame:
    """Volume, surface area, sphericity and (constant) solidity.

    face_weights ``reference`` keeps the customary exchange of the z and x face weights, which matters only where the
    two spacings differ; ``corrected`` weighs each face by its own area.
    """
    sz, sy, sx = spacing
    weight = {"z": sy * sx, "y": sz * sx, "x": sz * sy}
    if face_weights == "reference":
        weight["z"], weight["x"] = weight["x"], weight["z"]
    area = sum((F.col(f"faces_{a}") * F.lit(w) for a, w in weight.items()), F.lit(0.0))
    out = size(labels, spacing, by).join(exposed_faces(labels, by), list(by)).withColumn("surface_area_um2", area)
    sphericity = F.when(F.col("surface_area_um2") > 1e-6, F.lit(math.pi ** (1 / 3)) * F.pow(6 * F.col("volume_um3"), F.lit(2 / 3)) / F.col("surface_area_um2"))
    return out.select(*by, "volume_um3", "surface_area_um2", sphericity.alias("sphericity"), "voxel_count", F.lit(0.0).alias("solidity"))


def perimeter(labels: DataFrame, spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = LABEL) -> DataFrame:
    """Length of the contour at half height of each object: every 2 x 2 cell adds by which of its corners are set."""
    _, sy, sx = spacing
    corners = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in ((0, 0, 1), (0, -1, 2), (-1, 0, 4), (-1, -1, 8))))
    cells = labels.withColumn("_c", F.explode(corners)).groupBy(*by, (F.col("y") + F.col("_c.dy")).alias("cy"), (F.col("x") + F.col("_c.dx")).alias("cx")).agg(F.sum("_c.w").alias("code"))
    slant = F.lit(0.5 * math.sqrt(sy * sy + sx * sx))
    # Bits: 1 this cell's upper left corner, 2 upper right, 4 lower left, 8 lower right.
    length = F.when(F.col("code").isin(1, 2, 4, 8, 7, 11, 13, 14), slant).when(F.col("code").isin(6, 9), 2 * slant).when(F.col("code").isin(3, 12), F.lit(sx)).when(F.col("code").isin(5, 10), F.lit(sy)).otherwise(0.0)
    return cells.groupBy(*by).agg(F.sum(length).alias("perimeter_um"))


def eccentricity(labels: DataFrame, spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = LABEL) -> DataFrame:
    """sqrt(1 - smaller / larger eigenvalue) of the second central moments, each voxel being a unit square (+ 1/12)."""
    _, sy, sx = spacing
    y, x = F.col("y") * F.lit(sy), F.col("x") * F.lit(sx)
    m = labels.groupBy(*by).agg((F.var_pop(y) + sy * sy / 12).alias("a"), (F.var_pop(x) + sx * sx / 12).alias("b"), F.covar_pop(y, x).alias("c"))
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, F.lit(2)) + F.col("c") * F.col("c"))
    return m.select(*by, F.sqrt(F.greatest(F.lit(0.0), 1 - (half - root) / (half + root))).alias("eccentricity"))


def shape_2d(labels: DataFrame, spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = LABEL, area_mode: str = "corrected") -> DataFrame:
    """Area, perimeter, circularity, solidity by the convex hull of pixel corners, eccentricity.

    area_mode ``doubled`` multiplies the area by the pixel's once more, as some published tables have it.
    """
    unit = spacing[1] * spacing[2]
    base = size(labels, spacing, by, dims=2)
    if area_mode == "doubled":
        base = base.withColumn("area_um2", F.col("area_um2") * F.lit(unit))
    circ = F.when(F.col("perimeter_um") > 1e-6, F.least(F.lit(1.0), 4 * math.pi * F.col("area_um2") / F.pow("perimeter_um", F.lit(2))))
    out = base.join(perimeter(labels, spacing, by), list(by)).join(eccentricity(labels, spacing, by), list(by)).join(convex_area(labels, by), list(by))
    return out.select(*by, "area_um2", "perimeter_um", "pixel_count", circ.alias("circularity"), F.least(F.lit(1.0), F.col("pixel_count") / F.col("convex_pixels")).alias("solidity"), "eccentricity")


def convex_area(labels: DataFrame, by: tuple[str, ...] = LABEL) -> DataFrame:
    """Area in pixels of the convex hull of each object's pixel corners; only row ends go to the grouped map."""
    import numpy as np
    import pandas as pd

    ends = labels.groupBy(*by, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    schema = ", ".join(f"`{c}` {ends.schema[c].dataType.simpleString()}" for c in by) + ", convex_pixels double"

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        y, lo, hi = pdf["y"].to_numpy(float), pdf["lo"].to_numpy(float), pdf["hi"].to_numpy(float)
        pts = sorted({(a, b) for d in (-0.5, 0.5) for a, b in [*zip(lo - 0.5, y + d, strict=True), *zip(hi + 0.5, y + d, strict=True)]})

        def chain(points):
            out: list = []
            for p in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return out[:-1]

        ring = np.array(chain(pts) + chain(pts[::-1]))
        a, b = ring[:, 0], ring[:, 1]
        return pdf[list(by)].head(1).assign(convex_pixels=abs(float((a * np.roll(b, -1) - b * np.roll(a, -1)).sum())) / 2)

    return ends.groupBy(*by).applyInPandas(hull, schema)


def depth(labels: DataFrame, sz: float = 1.0, by: tuple[str, ...] = LABEL) -> DataFrame:
    return labels.groupBy(*by).agg((F.median("z") * F.lit(sz)).alias("depth_um"))


def intensity(labels: DataFrame, value: str = "intensity", by: tuple[str, ...] = LABEL) -> DataFrame:
    v = F.col(value)
    return labels.groupBy(*by).agg(F.avg(v).alias("mean_intensity"), F.median(v).alias("median_intensity"), F.stddev_pop(v).alias("std_intensity"), F.sum(v).alias("integrated_density"), F.max(v).alias("max_intensity"))


def boxes(labels: DataFrame, by: tuple[str, ...] = LABEL) -> DataFrame:
    return labels.groupBy(*by).agg(*(f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("min", F.min), ("max", F.max))), *(F.avg(a).alias(f"{a}_mean") for a in AXES))


def summary(labels: DataFrame, value: str = "intensity", spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = LABEL, dims: int = 3, least: int = 1) -> DataFrame:
    """size(), intensity() and boxes() of the objects with ``least`` voxels or more, by one aggregation."""
    unit, v = math.prod(spacing[3 - dims :]), F.col(value)
    count, extent = ("voxel_count", "volume_um3") if dims == 3 else ("pixel_count", "area_um2")
    spread = [f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    all_ = labels.groupBy(*by).agg(F.count("*").alias(count), (F.count("*") * F.lit(unit)).alias(extent), F.avg(v).alias("mean_intensity"), F.median(v).alias("median_intensity"), F.stddev_pop(v).alias("std_intensity"), F.sum(v).alias("integrated_density"), F.max(v).alias("max_intensity"), *spread)
    return all_.where(F.col(count) >= least)


def distance(a: str, b: str, spacing: Spacing) -> Column:
    """Between two points' columns (prefixes a and b), rounded to 32 bits as distances are compared."""
    return F.sqrt(sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * F.lit(s)) * ((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * F.lit(s)) for c, s in zip(AXES, spacing, strict=True))).cast("float")


def _points(labels: DataFrame, by: tuple[str, ...], dims: int, label: str, prefix: str) -> DataFrame:
    return surface(labels, (*by, label), dims).select(*by, F.col(label).alias(f"{prefix}label"), *(F.col(a).alias(f"{prefix}{a}") for a in AXES))


def distance_matrix(labels: DataFrame, spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = (), dims: int = 3, label: str = "label", reach: float | None = None, cell: int = 16) -> DataFrame:
    """Rows (label_a, label_b, distance_um), a < b: between the objects' surfaces, in long form.

    Without ``reach`` every pair of an image's objects is asked for, whose number is the output's; pairs.all_distances()
    gives them without a shuffle of pairs, those of large objects by cells (``cell`` voxels wide at the last). With it only
    pairs up to that distance are given: surface points meet in cells of that size, each with its neighbouring cells.
    """
    if reach is None:
        points = surface(labels, (*by, label), dims).select(*by, F.col(label).alias("label"), *AXES)
        out = all_distances(points, None, by, spacing, dims, cell)
        return out.select(*by, F.col("alabel").alias("label_a"), F.col("blabel").alias("label_b"), F.col("d").alias("distance_um"))
    pa, pb = _points(labels, by, dims, label, "a"), _points(labels, by, dims, label, "b")
    pairs = _near_pairs(pa, pb, by, spacing, reach, dims).where("alabel < blabel")
    out = pairs.groupBy(*by, F.col("alabel").alias("label_a"), F.col("blabel").alias("label_b")).agg(F.min(distance("a", "b", spacing)).alias("distance_um"))
    return out.where(F.col("distance_um") <= reach)


def _near_pairs(pa: DataFrame, pb: DataFrame, by: tuple[str, ...], spacing: Spacing, reach: float, dims: int = 3) -> DataFrame:
    """Points of pa with all points of pb up to ``reach`` away, and some beyond: cells of that size meet their neighbours.

    The points of pa are repeated for the neighbouring cells, so pa should be the smaller table.
    """
    axes = list(zip(AXES, spacing, strict=True))[3 - dims :]
    cells = lambda p: [F.floor(F.col(f"{p}{a}") * F.lit(s) / reach).alias(f"_{a}") for a, s in axes]
    left = pa.select("*", *cells("a"))
    for a, _ in axes:
        left = left.withColumn(f"_{a}", F.explode(F.array(*(F.col(f"_{a}") + d for d in (-1, 0, 1)))))
    return left.join(pb.select("*", *cells("b")), [*by, *(f"_{a}" for a, _ in axes)])


def nearest_objects(labels: DataFrame, spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = (), dims: int = 3, label: str = "label", reach: float = 4.0) -> DataFrame:
    """Per object its nearest one: shortest_distance_um, closest_neighbor_label (the smaller label on a tie) and both points.

    Exact without all pairs: objects look within ``reach`` first; those that found nothing look twice as far, and so on.
    An object that is alone in its image is absent. Points are the smallest (z, y, x) at the shortest distance.
    """
    pa = staged(_points(labels, by, dims, label, "a"))
    pb = pa.select(*by, F.col("alabel").alias("blabel"), *(F.col(f"a{a}").alias(f"b{a}") for a in AXES))
    alone = pa.select(*by, "alabel").distinct().groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n") if by else None
    todo = pa.join(alone, list(by), "left_semi") if by else pa
    span = pa.agg(*(((F.max(f"a{a}") - F.min(f"a{a}")) * F.lit(s)).alias(a) for a, s in zip(AXES, spacing, strict=True))).first()
    limit = math.sqrt(sum((v or 0) ** 2 for v in span)) + 1
    best = F.min(F.struct(distance("a", "b", spacing).alias("d"), F.col("blabel").alias("label"), *(F.col(f"a{a}").alias(f"a{a}") for a in AXES), *(F.col(f"b{a}").alias(f"b{a}") for a in AXES)))
    found = None
    while True:
        met = staged(_near_pairs(todo, pb, by, spacing, reach, dims).where("alabel != blabel").groupBy(*by, "alabel").agg(best.alias("m")).where(F.col("m.d") <= reach))
        found = met if found is None else found.unionByName(met)
        if reach > limit:
            break
        todo = todo.join(met.select(*by, "alabel"), [*by, "alabel"], "left_anti")
        if todo.isEmpty():
            break
        reach *= 2
    return found.select(*by, F.col("alabel").alias(label), F.col("m.d").alias("shortest_distance_um"), F.col("m.label").alias("closest_neighbor_label"), *(F.col(f"m.a{a}").cast("double").alias(f"mask1_{a}") for a in AXES), *(F.col(f"m.b{a}").cast("double").alias(f"mask2_{a}") for a in AXES))


def contact_points(nearest: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The contact-point table: each object, its nearest and the two points, as voxel indices."""
    return nearest.select(*by, F.col("label").alias("mask1"), F.col("closest_neighbor_label").alias("mask2"), *(F.col(f"mask{k}_{a}") for k in (1, 2) for a in AXES))


def merge_metrics(*tables: DataFrame, keys: tuple[str, ...] = LABEL, how: str = "outer") -> DataFrame:
    """Joins metric tables on the label; a later table's columns replace those that an earlier one already has."""
    out = tables[0]
    for t in tables[1:]:
        again = [c for c in out.columns if c in t.columns and c not in keys]
        out = out.drop(*again).join(t, list(keys), how)
    return out


def skeleton_degrees(skeleton: DataFrame, by: tuple[str, ...] = LABEL, dims: int = 2) -> DataFrame:
    """Skeleton voxels with ``degree``: how many neighbours of full connectivity they have in their object."""
    from .raster import box, shifted

    o = box(1, dims)
    votes = shifted(skeleton.select(*by, *AXES), o).groupBy(*by, *AXES).agg((F.count("*") - 1).alias("degree"), F.max((F.col("_o") == o.index((0, 0, 0))).cast("int")).alias("_own"))
    return votes.where("_own = 1").drop("_own")


def skeleton_counts(skeleton: DataFrame, by: tuple[str, ...] = LABEL, dims: int = 2) -> DataFrame:
    """Endpoints (degree 1), junction voxels (3 or more), branches max(0, endpoints - 1 + junctions) and voxels per object."""
    d = skeleton_degrees(skeleton, by, dims)
    counts = d.groupBy(*by).agg(F.sum((F.col("degree") == 1).cast("long")).alias("true_num_endpoints"), F.sum((F.col("degree") >= 3).cast("long")).alias("true_num_junctions"), F.count("*").alias("skan_num_skeleton_voxels"))
    return counts.withColumn("true_num_branches", F.greatest(F.lit(0).cast("long"), F.col("true_num_endpoints") - 1 + F.col("true_num_junctions")))
