"""How the objects of one channel (primary) and another (reference) overlap and how far apart they are."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged
from .measure import _near_pairs, distance
from .pairs import all_distances
from .raster import AXES, ball, box, components, cross, hole_voxels, shifted, surface

Spacing = tuple[float, float, float]


def overlay(primary: DataFrame, reference: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Voxels that both channels label: primary's columns and ``ref_label``; an equi-join on coordinates."""
    return primary.join(reference.select(*by, *AXES, F.col("label").alias("ref_label")), [*by, *AXES])


def overlap_per_primary(primary: DataFrame, reference: DataFrame, name: str, spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = (), dims: int = 3) -> DataFrame:
    """Per primary object: overlapping extent and fraction, whether any, the dominant partner and its overlapped fraction.

    The dominant partner has the most common voxels, the smaller label on a tie, and is 0 where there is none.
    """
    unit = math.prod(spacing[3 - dims :])
    extent = "overlap_vol_um3" if dims == 3 else "overlap_area_um2"
    key = [*by, "label"]
    pairs = overlay(primary, reference, by).groupBy(*key, "ref_label").agg(F.count("*").alias("n"))
    refs = reference.groupBy(*by, F.col("label").alias("ref_label")).agg(F.count("*").alias("ref_n"))
    best = pairs.groupBy(*key).agg(F.sum("n").alias("common"), F.max(F.struct(F.col("n").alias("n"), (-F.col("ref_label")).alias("m"))).alias("top"))
    top = best.select(*key, "common", F.col("top.n").alias("top_n"), (-F.col("top.m")).alias("ref_label")).join(refs, [*by, "ref_label"], "left")
    out = primary.groupBy(*key).agg(F.count("*").alias("n")).join(top, key, "left")
    none = F.lit(0)
    return out.select(
        *key,
        (F.coalesce("common", none) * F.lit(unit)).alias(f"{extent}_{name}"),
        (F.coalesce("common", none) / F.col("n")).alias(f"overlap_fraction_{name}"),
        (F.coalesce("common", none) > 0).alias(f"overlaps_any_{name}"),
        F.coalesce("ref_label", none).alias(f"dominant_overlap_id_{name}"),
        F.coalesce(F.col("top_n") / F.col("ref_n"), F.lit(0.0)).alias(f"overlap_fraction_of_partner_{name}"),
    )


def coverage(primary: DataFrame, reference: DataFrame, spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = (), dims: int = 3, clip: bool = True) -> DataFrame:
    """Per reference object that is overlapped: total overlap, number and ascending list of primaries, extent, percent covered."""
    unit = math.prod(spacing[3 - dims :])
    what = "vol_um3" if dims == 3 else "area_um2"
    pairs = overlay(primary, reference, by).groupBy(*by, "ref_label", "label").agg(F.count("*").alias("n"))
    refs = reference.groupBy(*by, F.col("label").alias("ref_label")).agg(F.count("*").alias("ref_n"))
    out = pairs.groupBy(*by, "ref_label").agg(F.sum("n").alias("n"), F.count_distinct("label").alias("interacting_cell_count"), F.sort_array(F.collect_list("label")).alias("interacting_labels")).join(refs, [*by, "ref_label"])
    percent = 100.0 * F.col("n") / F.when(F.col("ref_n") == 0, 1).otherwise(F.col("ref_n"))
    return out.select(*by, "ref_label", (F.col("n") * F.lit(unit)).alias(f"total_overlap_{what}"), "interacting_cell_count", "interacting_labels", (F.col("ref_n") * F.lit(unit)).alias(f"ref_total_{what}"), (F.least(F.lit(100.0), percent) if clip else percent).alias("percent_covered"))


def distance_to_reference(primary: DataFrame, reference: DataFrame, name: str, spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = (), dims: int = 3, reach: float = 4.0) -> DataFrame:
    """Per primary object the distance to the nearest reference voxel and that voxel's label.

    Of several primary voxels at the least distance the first in order of (z, y, x) decides, then the smallest label at
    that distance from it. Without any reference the distance is null and the label 0. Cells of a doubling size are
    looked through as far as is needed, so there are no all-pairs.
    """
    key = [*by, "label"]
    reference, primary = staged(reference), staged(primary)
    ref = reference.select(*by, F.col("label").alias("blabel"), *(F.col(a).alias(f"b{a}") for a in AXES))
    own = primary.select(*by, F.col("label").alias("alabel"), *(F.col(a).alias(f"a{a}") for a in AXES))
    names = primary.select(*key).distinct()
    if ref.isEmpty():
        return names.select(*key, F.lit(None).cast("float").alias(f"dist_to_nearest_{name}_um"), F.lit(0).cast(primary.schema["label"].dataType).alias(f"nearest_{name}_id"))
    span = primary.select(*AXES).unionByName(reference.select(*AXES)).agg(*(((F.max(a) - F.min(a)) * F.lit(s)).alias(a) for a, s in zip(AXES, spacing, strict=True))).first()
    limit = math.sqrt(sum((v or 0) ** 2 for v in span)) + 1
    best = F.min(F.struct(distance("a", "b", spacing).alias("d"), "az", "ay", "ax", "blabel"))
    # Objects that overlap are at distance 0, decided by their first overlapping voxel.
    touching = overlay(primary, reference, by).groupBy(*key).agg(F.min(F.struct(*AXES, "ref_label")).alias("t")).select(*by, F.col("label").alias("alabel"), F.lit(0.0).cast("float").alias("d"), F.col("t.ref_label").alias("id"))
    found, todo = touching, own.join(touching.select(*by, "alabel"), [*by, "alabel"], "left_anti")
    while not todo.isEmpty():
        met = staged(_near_pairs(todo, ref, by, spacing, reach, dims).groupBy(*by, "alabel").agg(best.alias("m")).where(F.col("m.d") <= reach).select(*by, "alabel", F.col("m.d").alias("d"), F.col("m.blabel").alias("id")))
        found = found.unionByName(met)
        if reach > limit:
            break
        todo = todo.join(met.select(*by, "alabel"), [*by, "alabel"], "left_anti")
        reach *= 2
    named = found.select(*by, F.col("alabel").alias("label"), "d", "id")
    return names.join(named, key, "left").select(*key, F.col("d").alias(f"dist_to_nearest_{name}_um"), F.coalesce("id", F.lit(0)).alias(f"nearest_{name}_id"))


def cross_distances(primary: DataFrame, reference: DataFrame, spacing: Spacing = (1.0, 1.0, 1.0), by: tuple[str, ...] = (), dims: int = 2) -> DataFrame:
    """Rows (channel_a_label, channel_b_label, distance_um) for every pair of a primary and a reference object of an image.

    All pairs are the result here (see pairs.all_distances()); use distance_to_reference() for the nearest alone.
    """
    pa, pb = (surface(t, (*by, "label"), dims) for t in (primary, reference))
    out = all_distances(pa, pb, by, spacing, dims)
    return out.select(*by, F.col("alabel").alias("channel_a_label"), F.col("blabel").alias("channel_b_label"), F.col("d").alias("distance_um"))


def overlap_regions(primary: DataFrame, reference: DataFrame, id_col: str = "id", dims: int = 2) -> DataFrame:
    """Voxels of the overlap, labelled as components of full connectivity."""
    return components(overlay(primary, reference).drop("label", "ref_label"), id_col, full=True, dims=dims)


# ------------------------------------------------------------------------------------------------ regions of one cell


def multi_seed_cells(labels: DataFrame, seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (label, somas) for cells with several seeds: their seeds' ids, ascending."""
    met = labels.join(seeds.select(*by, *AXES, F.col("label").alias("seed")), [*by, *AXES]).select(*by, "label", "seed").distinct()
    return met.groupBy(*by, "label").agg(F.sort_array(F.collect_set("seed")).alias("somas")).where(F.size("somas") > 1)


def interfaces(segments: DataFrame, by: tuple[str, ...] = ("cell",), dims: int = 2) -> DataFrame:
    """Rows (by, a, b, z, y, x), a < b: voxels of segment b that a's box dilation reaches within their cell."""
    moves = [o for o in box(1, dims) if any(o)]
    reach = shifted(segments.select(*by, F.col("label").alias("a"), *AXES), moves).drop("_o")
    return reach.join(segments.select(*by, F.col("label").alias("b"), *AXES), [*by, *AXES]).where("a < b").distinct()


def region_graph(segments: DataFrame, by: tuple[str, ...] = ("cell",), dims: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (by, label, volume) and edges (by, a, b, contact) of the adjacent segments of each cell."""
    nodes = segments.groupBy(*by, "label").agg(F.count("*").alias("volume"))
    edges = interfaces(segments, by, dims).groupBy(*by, "a", "b").agg(F.count("*").alias("contact"))
    return nodes, edges


def interface_metrics(segments: DataFrame, seed_means: DataFrame, least_ratio: float, value: str = "intensity", by: tuple[str, ...] = ("cell",), dims: int = 2) -> DataFrame:
    """Edges with ``ratio``: mean intensity on the interface over the brighter seed's mean (1e-6 at least); and if it suffices."""
    at = interfaces(segments, by, dims).join(segments.select(*by, *AXES, value), [*by, *AXES])
    edges = at.groupBy(*by, "a", "b").agg(F.avg(value).alias("mean"), F.count("*").alias("contact"))
    side = lambda x: seed_means.select(*by, F.col("label").alias(x), F.col("mean").alias(f"mean_{x}"))
    both = edges.join(side("a"), [*by, "a"], "left").join(side("b"), [*by, "b"], "left")
    ratio = F.col("mean") / F.greatest(F.coalesce("mean_a", F.lit(0.0)), F.coalesce("mean_b", F.lit(0.0)), F.lit(1e-6))
    return both.select(*by, "a", "b", "contact", ratio.alias("ratio"), (ratio >= least_ratio).alias("bright"))


def local_contrast(segments: DataFrame, radius: int, least: float, value: str = "intensity", by: tuple[str, ...] = ("cell",), dims: int = 2, fewest: int = 20) -> DataFrame:
    """Edges with the two sides' means near their interface and whether these are distinct.

    The zone is the interface grown by a ball of the radius (a box of 3 up to radius 1). Distinct if a side has fewer
    than 20 voxels in it, if the greater mean is below 1e-6, or if the means differ by ``least`` of the greater.
    """
    grow = ball(radius, dims=dims) if radius > 1 else box(1, dims)
    zone = shifted(interfaces(segments, by, dims), grow).drop("_o").distinct()
    inside = zone.join(segments.select(*by, *AXES, "label", value), [*by, *AXES]).where("label = a or label = b")
    side = lambda x: F.col("label") == F.col(x)
    sums = inside.groupBy(*by, "a", "b").agg(*(e for x in ("a", "b") for e in (F.count(F.when(side(x), 1)).alias(f"n_{x}"), F.avg(F.when(side(x), F.col(value))).alias(f"m_{x}"))))
    top = F.greatest(F.coalesce("m_a", F.lit(0.0)), F.coalesce("m_b", F.lit(0.0)))
    distinct = (F.col("n_a") < fewest) | (F.col("n_b") < fewest) | (top < 1e-6) | (F.abs(F.col("m_a") - F.col("m_b")) / F.greatest(top, F.lit(1e-6)) >= least)
    return sums.select(*by, "a", "b", "n_a", "n_b", "m_a", "m_b", F.coalesce(distinct, F.lit(True)).alias("distinct_sides"))


def merge_decisions(metrics: DataFrame, contrast: DataFrame, by: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Edges with should_merge: the interface is bright, or the sides are not distinct."""
    return metrics.join(contrast, [*by, "a", "b"], "left").select(*by, "a", "b", "ratio", (F.col("bright") | ~F.coalesce("distinct_sides", F.lit(True))).alias("should_merge"))


def stitch_pairs(left: DataFrame, right: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows (a, b, merge) for labels of two chunks that share voxels: they merge unless both have seeds and none in common.

    left and right hold (z, y, x, label), seeds (label, seeds array) for both sides' labels.
    """
    met = left.select(*AXES, F.col("label").alias("a")).join(right.select(*AXES, F.col("label").alias("b")), list(AXES)).select("a", "b").distinct()
    side = lambda x: seeds.select(F.col("label").alias(x), F.col("seeds").alias(f"s{x}"))
    empty = F.array().cast(seeds.schema["seeds"].dataType)
    both = met.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce("sa", empty).alias("sa"), F.coalesce("sb", empty).alias("sb"))
    return both.select("a", "b", (~((F.size("sa") > 0) & (F.size("sb") > 0) & ~F.arrays_overlap("sa", "sb"))).alias("merge"))


def orphan_targets(fragments: DataFrame, segments: DataFrame, by: tuple[str, ...] = ("cell",), dims: int = 2) -> DataFrame:
    """For each seedless fragment the segment of its cell that borders it most (the smaller label on a tie): (by, fragment, target).

    All fragments are decided at once, on the segments as they are. A fragment without neighbours is absent.
    """
    moves = [o for o in box(1, dims) if any(o)]
    rim = shifted(fragments.select(*by, "fragment", *AXES), moves).drop("_o").distinct()
    met = rim.join(segments.select(*by, *AXES, F.col("label").alias("target")), [*by, *AXES]).groupBy(*by, "fragment", "target").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by, "fragment").orderBy(F.desc("n"), "target")
    return met.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "fragment", "target")


def settle_orphans(segments: DataFrame, least: int = 0, by: tuple[str, ...] = ("cell",), dims: int = 2) -> DataFrame:
    """segments (by, id, z, y, x, label, seed) with labels so changed that every part of a label holds a seed.

    Parts are rank-1 connected. One without a seed, of a label that has several parts, goes to the other label of its
    cell that its box dilation meets most; with none it stays, or is deleted if it has fewer than ``least`` voxels. A
    label in one part stays as it is. All are decided at once. seed is null where no seed lies, id is unique.
    """
    named = segments.withColumnRenamed("label", "_segment")
    parts = staged(components(named, "id", dims=dims, by=(*by, "_segment")).withColumnRenamed("label", "fragment"))
    sizes = parts.groupBy(*by, "_segment", "fragment").agg(F.count("*").alias("_n"), F.max(F.col("seed").isNotNull()).alias("_seeded"))
    several = sizes.groupBy(*by, "_segment").agg(F.count("*").alias("_parts")).where("_parts > 1").drop("_parts")
    orphans = staged(sizes.join(several, [*by, "_segment"]).where("not _seeded").select(*by, "_segment", "fragment", "_n"))
    moves = [o for o in box(1, dims) if any(o)]
    rim = shifted(parts.join(orphans, [*by, "_segment", "fragment"]).select(*by, "_segment", "fragment", *AXES), moves).drop("_o").distinct()
    met = rim.join(parts.select(*by, *AXES, F.col("_segment").alias("target")), [*by, *AXES]).where("target != _segment").groupBy(*by, "_segment", "fragment", "target").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by, "_segment", "fragment").orderBy(F.desc("n"), "target")
    best = met.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "_segment", "fragment", "target")
    fate = orphans.join(best, [*by, "_segment", "fragment"], "left")
    out = parts.join(fate, [*by, "_segment", "fragment"], "left").where(F.col("target").isNotNull() | F.col("_n").isNull() | (F.col("_n") >= least))
    return out.withColumn("label", F.coalesce("target", "_segment")).select(*segments.columns)


def fill_voids(labels: DataFrame, domain: DataFrame, dims: int = 3) -> DataFrame:
    """labels (z, y, x, label) and the voids that one object alone encloses: background parts that don't reach the border.

    domain: (id, z, y, x) covers the whole raster. A void that borders several objects stays empty.
    """
    voids = staged(hole_voxels(labels, domain, dims=dims))
    parts = staged(components(voids, dims=dims).withColumnRenamed("label", "_void"))
    rim = shifted(parts.select("_void", *AXES), [o for o in cross(1, dims) if any(o)]).drop("_o")
    owner = rim.join(labels, list(AXES)).groupBy("_void").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other").drop("_other")
    return labels.select(*AXES, "label").unionByName(parts.join(owner, "_void").select(*AXES, "label"))
