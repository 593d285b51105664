"""Operators on rasters that are given as relations of coordinates.

A mask is a DataFrame with the columns z, y, x (2D: z = 0); a voxel that is absent is background. ``by`` names columns
that keep images (or labels) apart. Neighbourhoods are lists of (dz, dy, dx) that are exploded and then aggregated on the
shifted coordinates: one exchange, partial aggregation before it, no join and no distance predicate.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, staged

AXES = ("z", "y", "x")
Offsets = list[tuple[int, int, int]]


def cross(radius: int = 1, dims: int = 2) -> Offsets:
    """The L1 ball: ``radius`` iterations of the rank-1 neighbourhood."""
    return [o for o in box(radius, dims) if sum(map(abs, o)) <= radius]


def box(radius: int = 1, dims: int = 2) -> Offsets:
    span = range(-radius, radius + 1)
    return [o for o in product(span if dims == 3 else [0], span, span)]


def ball(radius: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), dims: int = 2) -> Offsets:
    """All offsets within a physical distance; a disk in 2D."""
    reach = [math.floor(radius / s) for s in spacing]
    spans = [range(-r, r + 1) for r in reach]
    return [o for o in product(spans[0] if dims == 3 else [0], spans[1], spans[2]) if sum((d * s) ** 2 for d, s in zip(o, spacing, strict=True)) <= radius**2 + 1e-9]


def shifted(df: DataFrame, offsets: Offsets) -> DataFrame:
    """df once for each offset, with it added to the coordinates; ``_o`` is the offset's number."""
    moves = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True))) for k, o in enumerate(offsets)))
    rest = [c for c in df.columns if c not in AXES]
    return df.withColumn("_m", F.explode(moves)).select(*rest, *((F.col(a) + F.col(f"_m.d{a}")).alias(a) for a in AXES), F.col("_m.k").alias("_o"))


def dilate(mask: DataFrame, offsets: Offsets, by: tuple[str, ...] = (), shape: tuple[int, int, int] | None = None) -> DataFrame:
    """The mask grown by the (symmetric) offsets; clipped to ``shape`` if given."""
    out = shifted(mask.select(*by, *AXES), offsets).drop("_o").distinct()
    return out.where(inside(shape)) if shape else out


def inside(shape: tuple[int, int, int]) -> Column:
    cond = F.lit(True)
    for a, n in zip(AXES, shape, strict=True):
        cond = cond & (F.col(a) >= 0) & (F.col(a) < n)
    return cond


def erode(mask: DataFrame, offsets: Offsets, by: tuple[str, ...] = ()) -> DataFrame:
    """Voxels whose whole neighbourhood is foreground; what lies outside the raster is background."""
    votes = shifted(mask.select(*by, *AXES), offsets).groupBy(*by, *AXES).agg(F.count("*").alias("_n"))
    return votes.where(F.col("_n") == len(offsets)).drop("_n")


def close_gaps(mask: DataFrame, offsets: Offsets, by: tuple[str, ...] = ()) -> DataFrame:
    return erode(dilate(mask, offsets, by), offsets, by)


def open_spots(mask: DataFrame, offsets: Offsets, by: tuple[str, ...] = ()) -> DataFrame:
    return dilate(erode(mask, offsets, by), offsets, by)


def surface(labels: DataFrame, by: tuple[str, ...] = (), dims: int = 2) -> DataFrame:
    """Voxels with a rank-1 neighbour that is not of their own object (``by`` with the label): object minus its erosion."""
    o = cross(1, dims)
    votes = shifted(labels.select(*by, *AXES), o).groupBy(*by, *AXES).agg(F.count("*").alias("_n"), F.max((F.col("_o") == o.index((0, 0, 0))).cast("int")).alias("_own"))
    return votes.where((F.col("_own") == 1) & (F.col("_n") < len(o))).drop("_n", "_own")


def clamped_z_erosion(mask: DataFrame, iterations: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Erodes along z; of a (y, x) column that would vanish its middle voxel stays, if it was foreground.

    The middle lies between the column's lowest and highest voxel, rounded down. Voxels outside are background.
    """
    keys = [*by, "y", "x"]
    runs = mask.select(*by, *AXES).withColumn("_g", F.col("z") - F.row_number().over(Window.partitionBy(*keys).orderBy("z")))
    column, run = Window.partitionBy(*keys), Window.partitionBy(*keys, "_g")
    marked = runs.select("*", F.min("z").over(run).alias("_a"), F.max("z").over(run).alias("_b")).withColumn("_stays", (F.col("z") - F.col("_a") >= iterations) & (F.col("_b") - F.col("z") >= iterations))
    whole = marked.select("*", F.max(F.col("_stays").cast("int")).over(column).alias("_any"), ((F.min("z").over(column) + F.max("z").over(column)) / 2).cast("long").alias("_mid"))
    return whole.where(F.col("_stays") | ((F.col("_any") == 0) & (F.col("z") == F.col("_mid")))).select(*by, *AXES)


def exposed_faces(labels: DataFrame, by: tuple[str, ...], dims: int = 3) -> DataFrame:
    """Per object the faces along each axis: two for every unbroken run of voxels along it."""
    out = labels.select(*by, *AXES)
    for a in AXES:
        if dims == 2 and a == "z":
            continue
        w = Window.partitionBy(*by, *(b for b in AXES if b != a)).orderBy(a)
        out = out.withColumn(f"_s{a}", F.coalesce((F.col(a) - F.lag(a).over(w) > 1).cast("int"), F.lit(1)))
    return out.groupBy(*by).agg(*((2 * F.sum(f"_s{a}")).alias(f"faces_{a}") for a in AXES if f"_s{a}" in out.columns))


# ---------------------------------------------------------------------------------------------------- components


def components(mask: DataFrame, id_col: str = "id", full: bool = False, dims: int = 2, tile: int = 128, by: tuple[str, ...] = ()) -> DataFrame:
    """mask with ``label``: the smallest ``id_col`` of its connected component (rank-1 or full connectivity).

    Inside tiles by union-find; then components that meet across a tile border are joined as a graph whose size is that
    of the borders, in a logarithmic number of rounds. ``id_col`` must be unique over all images. Extra columns stay.
    """
    half = [o for o in (box(1, dims) if full else cross(1, dims)) if o > (0, 0, 0)]
    keys = [F.floor(F.col(a) / tile).cast("long").alias(f"_t{a}") for a in AXES]
    schema = mask.select(*by, *AXES, F.col(id_col).cast("long").alias("_id")).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", _local long"

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[list(AXES)].to_numpy(np.int64)
        low = at.min(axis=0)
        shape = at.max(axis=0) - low + 1
        grid = np.full(shape, -1, np.int64)
        rel = at - low
        grid[rel[:, 0], rel[:, 1], rel[:, 2]] = np.arange(len(at))
        pairs = []
        for d in half:
            to = rel + d
            ok = ((to >= 0) & (to < shape)).all(axis=1)
            other = np.full(len(at), -1, np.int64)
            other[ok] = grid[to[ok, 0], to[ok, 1], to[ok, 2]]
            pairs.append(np.stack([np.flatnonzero(other >= 0), other[other >= 0]], 1))
        edges = np.concatenate(pairs)
        ids = pdf["_id"].to_numpy()
        value = ids.copy()
        while len(edges):  # minima spread along edges, then along the pointers they make
            m = np.minimum(value[edges[:, 0]], value[edges[:, 1]])
            before = value.copy()
            np.minimum.at(value, edges[:, 0], m)
            np.minimum.at(value, edges[:, 1], m)
            order = np.argsort(ids)
            value = value[order[np.searchsorted(ids, value, sorter=order)]]
            if (value == before).all():
                break
        return pdf[[*by, *AXES, "_id"]].assign(_local=value)

    rows = mask.select(*by, *AXES, F.col(id_col).cast("long").alias("_id"), *keys)
    labelled = staged(rows.groupBy(*by, *(f"_t{a}" for a in AXES)).applyInPandas(local, out))
    edge = F.lit(False)
    for a in AXES if dims == 3 else AXES[1:]:
        edge = edge | (F.pmod(F.col(a), F.lit(tile)) == 0) | (F.pmod(F.col(a), F.lit(tile)) == tile - 1)
    border = labelled.where(edge)
    mine = border.select(*by, *AXES, F.col("_local").alias("a"))
    theirs = shifted(border.select(*by, *AXES, F.col("_local").alias("b")), half).drop("_o")
    links = mine.join(theirs, [*by, *AXES]).where("a != b").select("a", "b").distinct()
    joined = connected_components(links).withColumnRenamed("node", "_local")
    label = labelled.join(joined, "_local", "left").select("_id", F.coalesce("component", "_local").alias("label"))
    return mask.join(label, mask[id_col].cast("long") == label["_id"]).drop("_id")


def numbered(voxels: DataFrame, to: str = "id") -> DataFrame:
    """voxels with a unique number by position, ascending in z, y, x; coordinates from 0 on. A raster too large for it fails."""
    top = voxels.agg(*(F.max(a).alias(a) for a in AXES)).first()  # one row
    nz, ny, nx = ((top[a] or 0) + 1 for a in AXES)
    if nz * ny * nx >= 1 << 63:
        raise ValueError(f"a raster of {nz} x {ny} x {nx} has no 64-bit numbers")
    z, y, x = (F.col(a).cast("long") for a in AXES)
    return voxels.withColumn(to, (z * ny + y) * nx + x)


def size_filter(labels: DataFrame, least: int, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Drops objects of fewer than ``least`` voxels: globally, not chunk by chunk."""
    big = labels.groupBy(*by, label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return labels.join(big, [*by, label], "left_semi")


def largest_component(labels: DataFrame, label: str = "label") -> DataFrame:
    """The voxels of the object with most of them; the smaller label on a tie."""
    top = labels.groupBy(label).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), label).limit(1).select(label)
    return labels.join(F.broadcast(top), label, "left_semi")  # one row


def relabel(labels: DataFrame, label: str = "label", to: str = "new_label", by: tuple[str, ...] = ()) -> DataFrame:
    """A look-up table (label, new label): dense numbers from 1 by ascending old label.

    Ranks come from a range sort with per-partition counts, so no task sees all labels even with one image.
    """
    spark = labels.sparkSession
    names = labels.select(*by, label).distinct()
    if by:
        return names.withColumn(to, F.row_number().over(Window.partitionBy(*by).orderBy(label)).cast("long"))
    sorted_ = names.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), label).sortWithinPartitions(label).withColumn("_p", F.spark_partition_id())
    sorted_ = staged(sorted_)  # read twice: sampled again, the ranges could differ
    counted = sorted_.groupBy("_p").agg(F.count("*").alias("_n"))
    base = counted.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    ranked = sorted_.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(label)))
    return ranked.join(F.broadcast(base), "_p").select(label, (F.col("_b") + F.col("_r")).cast("long").alias(to))  # a row for each partition


def apply_lut(labels: DataFrame, lut: DataFrame, label: str = "label", to: str = "new_label", by: tuple[str, ...] = ()) -> DataFrame:
    """Replaces labels by the table's; labels that it lacks become background."""
    return labels.join(lut.select(*by, label, to), [*by, label]).drop(label).withColumnRenamed(to, label)


def hole_voxels(mask: DataFrame, domain: DataFrame, id_col: str = "id", shape: tuple[int, int, int] | None = None, dims: int = 2) -> DataFrame:
    """Background voxels of the domain whose rank-1 component does not reach the raster's border."""
    empty = domain.join(mask.select(*AXES), list(AXES), "left_anti")
    parts = components(empty, id_col, dims=dims)
    span = domain.agg(*(f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    touching = F.lit(False)
    for a in AXES if dims == 3 else AXES[1:]:
        touching = touching | (F.col(a) == F.col(f"_lo{a}")) | (F.col(a) == F.col(f"_hi{a}"))
    open_ = parts.join(F.broadcast(span)).where(touching).select("label").distinct()  # one row
    return parts.join(open_, "label", "left_anti").select(*domain.columns)


# ---------------------------------------------------------------------------------------------------- distances


def _pass(pdf: pd.DataFrame, axis: str, step: float) -> pd.DataFrame:
    """One pass of the exact transform (Felzenszwalb and Huttenlocher 2012) along ``axis`` for each line of pdf."""
    rest = [a for a in AXES if a != axis]
    pdf = pdf.sort_values([*rest, axis], kind="stable").reset_index(drop=True)
    d2 = pdf["d2"].to_numpy()
    at = pdf[axis].to_numpy(np.float64) * step
    out, source = d2.copy(), np.arange(len(pdf))
    keys = pdf[rest].to_numpy()
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
        sites = [i for i in range(a, b) if d2[i] < math.inf]
        if not sites:
            continue
        hull, left = [sites[0]], [-math.inf]
        for i in sites[1:]:
            while True:
                j = hull[-1]
                s = (d2[i] + at[i] ** 2 - d2[j] - at[j] ** 2) / (2 * (at[i] - at[j]))
                if s > left[-1]:
                    break
                hull.pop()
                left.pop()
            hull.append(i)
            left.append(s)
        k = np.searchsorted(np.array(left), at[a:b], "left") - 1
        near = np.array(hull)[np.maximum(k, 0)]
        out[a:b] = (at[a:b] - at[near]) ** 2 + d2[near]
        source[a:b] = near
    return pdf.assign(d2=out, near=pdf["near"].to_numpy()[source])


def _along(axis: str, step: float):
    return lambda pdf: _pass(pdf, axis, step)[[*AXES, "d2", "near"]]


def distance_transform(domain: DataFrame, features: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), dims: int = 2, lines: int = 64, nearest: str | None = None) -> DataFrame:
    """domain's coordinates with ``distance``: exact, to the nearest feature voxel; null if there is none.

    ``nearest`` names an integer column of features that is carried along: whose feature it is (of equally near ones any).
    Separable: one grouped map for each axis, each group some whole lines along it, so no halo is needed.
    """
    named = features.select(*AXES, (F.col(nearest) if nearest else F.lit(0)).cast("long").alias("near")).groupBy(*AXES).agg(F.min("near").alias("near"), F.lit(True).alias("_f"))
    marked = domain.select(*AXES).join(named, list(AXES), "left")
    rows = marked.select(*(F.col(a).cast("long").alias(a) for a in AXES), F.when(F.col("_f"), 0.0).otherwise(math.inf).alias("d2"), F.coalesce("near", F.lit(0)).alias("near"))
    for axis, step in reversed(list(zip(AXES, spacing, strict=True))):
        if axis == "z" and dims == 2:
            continue
        rest = [a for a in AXES if a != axis]
        block = [F.floor(F.col(a) / (lines if a == rest[-1] else 1)).alias(f"_{a}") for a in rest]
        rows = rows.groupBy(*block).applyInPandas(_along(axis, step), "z long, y long, x long, d2 double, near long")
    known = F.col("d2") < math.inf
    return rows.select(*AXES, F.when(known, F.sqrt("d2")).alias("distance"), *([F.when(known, F.col("near")).alias(nearest)] if nearest else []))


def within(voxels: DataFrame, features: DataFrame, radius: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), dims: int = 2) -> DataFrame:
    """Voxels (all columns) at most ``radius`` from a feature: an equi-join on the features grown by the ball."""
    return voxels.join(dilate(features, ball(radius, spacing, dims)), list(AXES), "left_semi")


def zero_edge_trim(labels: DataFrame, intensity: DataFrame, distance: float, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), floor: float = 1e-4, value: str = "intensity", dims: int = 2) -> DataFrame:
    """Deletes labels nearer than ``distance`` to intensities below ``floor``; if that is less than a mean voxel, up to 1.5 of those too."""
    used = spacing[3 - dims :]
    mean = sum(used) / len(used)
    near = [o for o in ball(distance, spacing, dims) if sum((d * s) ** 2 for d, s in zip(o, spacing, strict=True)) < distance**2]
    if distance < mean:
        near = sorted({*near, *ball(1.5 * mean, spacing, dims)})
    zero = intensity.where(F.col(value) < floor).select(*AXES)
    return labels.join(dilate(zero, near), list(AXES), "left_anti") if near else labels


def edge_trim(labels: DataFrame, outside: DataFrame, bright: DataFrame, distance: float, core_iterations: int, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), dims: int = 2) -> DataFrame:
    """Deletes labels nearer than ``distance`` to what lies outside the hull, unless within the grown bright core."""
    near = [o for o in ball(distance, spacing, dims) if sum((d * s) ** 2 for d, s in zip(o, spacing, strict=True)) < distance**2]
    doomed = dilate(outside, near).join(dilate(bright, cross(core_iterations, dims)), list(AXES), "left_anti")
    return labels.join(doomed, list(AXES), "left_anti")


def core_iterations(spacing_um: float, reach_um: float = 6.0) -> int:
    return min(10, max(2, int(reach_um / spacing_um)))


# ---------------------------------------------------------------------------------------------------- set operations


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AXES).unionByName(b.select(*AXES)).distinct()


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AXES).intersect(b.select(*AXES))


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*AXES).subtract(b.select(*AXES))


def mask_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """In exactly one of two masks; each must hold a voxel once."""
    return a.select(*AXES).unionByName(b.select(*AXES)).groupBy(*AXES).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


# ---------------------------------------------------------------------------------------------------- tiles


def object_tiles(labels: DataFrame, size: tuple[int, int, int] = (128, 512, 512), pad: int = 20, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Rows (by, t0z, t1z, p0z, p1z, ...) that cut each object's box into tiles from its lower corner on.

    t0 to t1 (excluded) is what a tile is answerable for, p0 to p1 what it looks at: ``pad`` more on all sides, within the box.
    """
    out = labels.groupBy(*by).agg(*(e for a in AXES for e in (F.min(a).cast("long").alias(f"_lo{a}"), (F.max(a) + 1).cast("long").alias(f"_hi{a}"))))
    for a, s in zip(AXES, size, strict=True):
        low, high, start = F.col(f"_lo{a}"), F.col(f"_hi{a}"), F.col(f"t0{a}")
        out = out.withColumn(f"t0{a}", F.explode(F.sequence(low, high - 1, F.lit(s).cast("long")))).withColumn(f"t1{a}", F.least(start + s, high))
        out = out.withColumn(f"p0{a}", F.greatest(low, start - pad)).withColumn(f"p1{a}", F.least(high, F.col(f"t1{a}") + pad))
    return out.select(*by, *(f"{k}{a}" for a in AXES for k in ("t0", "t1", "p0", "p1")))


def in_tiles(df: DataFrame, size: tuple[int, int, int], halo: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """df with tz, ty, tx for every tile whose haloed box holds the voxel, and ``own``: whether it lies in the tile proper."""
    for a, s, h in zip(AXES, size, halo, strict=True):
        c = F.col(a)
        df = df.withColumn(f"t{a}", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((c - h) / s)), F.floor((c + h) / s))))
    own = F.lit(True)
    for a, s in zip(AXES, size, strict=True):
        own = own & (F.col(f"t{a}") == F.floor(F.col(a) / s))
    return df.withColumn("own", own)


def overlapping_chunks(df: DataFrame, size: tuple[int, int, int], overlap: int) -> DataFrame:
    """df with the chunk numbers cz, cy, cx of every chunk that holds the voxel; chunks start every size - overlap voxels."""
    for a, s in zip(AXES, size, strict=True):
        step = max(1, s - overlap)
        first = F.greatest(F.lit(0), F.floor((F.col(a) - s) / step) + 1)
        df = df.withColumn(f"c{a}", F.explode(F.sequence(first, F.floor(F.col(a) / step))))
    return df


def downsample(mask: DataFrame, factor: int, dims: int = 2) -> DataFrame:
    """Nearest-neighbour downsampling in y and x: the voxels at multiples of the factor, divided by it."""
    return mask.where((F.col("y") % factor == 0) & (F.col("x") % factor == 0)).select("z", (F.col("y") / factor).cast("long").alias("y"), (F.col("x") / factor).cast("long").alias("x"))


def upsample(mask: DataFrame, factor: int) -> DataFrame:
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    return mask.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).select("z", (F.col("y") * factor + F.col("_i")).alias("y"), (F.col("x") * factor + F.col("_j")).alias("x"))
