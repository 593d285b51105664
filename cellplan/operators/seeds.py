"""Seeds inside objects: cores by distance or intensity levels, their fragments, and greedy placement in order of merit."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .graph import connected_components, staged
from .raster import AXES, relabel

#: Levels by default: shares of the largest distance, and intensity percentiles.
RATIOS = (0.3, 0.4, 0.5, 0.6)
PERCENTILES = (100, 90, 80, 70, 60, 50, 40, 30)


def strategies(ratios=RATIOS, percentiles=PERCENTILES) -> list[tuple[str, float, float]]:
    """(kind, level, score), best first: intensity levels score 2 + p / 1000, distance levels r + r / 1000."""
    out = [("intensity", float(p), 2 + p / 1000) for p in percentiles] + [("distance", float(r), r + r / 1000) for r in ratios]
    return sorted(out, key=lambda s: -s[2])


def size_statistics(labels: DataFrame, low: float, high: float, every: int = 1) -> DataFrame:
    """One row: percentiles low and high of the objects' sizes, of every k-th object by label."""
    from .levels import every_kth, percentile

    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    return (every_kth(sizes, "label", every) if every > 1 else sizes).agg(percentile("n", low).alias("low"), percentile("n", high).alias("high"))


def reference_labels(labels: DataFrame, low: float, high: float, fewest: int = 5, most: int = 30) -> DataFrame:
    """Labels of typical size (low < size <= high), the first ``most`` by label; with too few of them the first ones at all."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    limits = sizes.agg(F.percentile("n", low / 100).alias("a"), F.percentile("n", high / 100).alias("b"))
    typical = sizes.join(F.broadcast(limits)).where("n > a and n <= b").select("label").orderBy("label").limit(most)  # one row
    first = sizes.select("label").orderBy("label").limit(most)
    count = F.broadcast(typical.agg(F.count("*").alias("c")))
    return typical.join(count).where(F.col("c") >= fewest).select("label").unionByName(first.join(count).where(F.col("c") < fewest).select("label"))


def least_thickness(thickness: Column, p: float, absolute_min: float, absolute_max: float) -> Column:
    """The percentile of the reference objects' thickness, within the absolute bounds."""
    return F.least(F.greatest(F.lit(absolute_min), F.percentile(thickness, p / 100)), F.lit(absolute_max - 0.1))


def candidates(mask: np.ndarray, intensity: np.ndarray, spacing=(1.0, 1.0, 1.0), ratios=RATIOS, percentiles=PERCENTILES, least_fragment: int = 30, least_thick: float = 1.5, most_thick: float = 10.0, most_aspect: float = 10.0, erosion: int = 0, peak_um: float = 0.0) -> list[tuple[float, int, np.ndarray]]:
    """(score, size, voxels) of one object's core fragments that are large, thick and round enough."""
    dt = kernels.edt(mask, spacing)
    out = []
    flat = mask.shape[0] == 1
    for kind, level, score in strategies(ratios, percentiles):
        core = mask & (dt >= level * dt.max()) if kind == "distance" else mask & (intensity >= np.percentile(intensity[mask], level))
        for _ in range(erosion):
            core = core & (kernels.edt(core) > 1)
        parts, n = kernels.label_components(core)
        for k in range(1, n + 1):
            part = parts == k
            tops = kernels.peaks(kernels.edt(part, spacing), part, kernels.peak_distance(spacing[1:] if flat else spacing, peak_um)) if peak_um > 0 else []
            if len(tops) > 1:
                markers = np.zeros(mask.shape, np.int64)
                for i, p in enumerate(tops, 1):
                    markers[p] = i
                flooded = kernels.watershed(-dt, markers, part)
                pieces = [flooded == i for i in range(1, len(tops) + 1)]
            else:
                pieces = [part]
            for piece in pieces:
                size = int(piece.sum())
                thick = dt[piece].max() if size else 0.0
                if size < least_fragment or not least_thick <= thick <= most_thick:
                    continue
                at = np.argwhere(piece)
                if size > (5 if flat else 10):
                    ev = np.linalg.eigvalsh(np.cov((at * np.array(spacing))[:, 1 if flat else 0 :].T))
                    if math.sqrt(ev[-1] / max(ev[0], 1e-12)) > most_aspect:
                        continue
                out.append((score, size, at))
    return out


def extract_seeds(cells: DataFrame, value: str = "intensity", spacing=(1.0, 1.0, 1.0), least_fragment: int = 30, separation_um: float = 7.0, least_thickness: float = 1.5, most_thickness: float = 10.0, most_aspect: float = 10.0, ratios=RATIOS, percentiles=PERCENTILES, peak_um: float = 0.0, apart_within: bool = False) -> DataFrame:
    """Seed voxels (label, seed, z, y, x) of every object.

    Candidates come from one grouped map an object. They are placed best first (score, then size): one is rejected if
    its centroid is nearer than ``separation_um`` to a seed of another object placed before, or if any of its voxels is
    taken. Seeds of one object are kept apart from each other only with ``apart_within``. Placement goes by order, but
    only candidates that are near each other matter to each other: objects with such candidates are joined to groups,
    and each group is placed by itself. Seeds are numbered from 1 in the order of placement, image by image.
    """
    by = ["image_id"] if "image_id" in cells.columns else []
    schema = "".join(f"`{c}` {cells.schema[c].dataType.simpleString()}, " for c in by)
    lab = cells.schema["label"].dataType.simpleString()

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        low, _, (grid, val) = kernels.dense(pdf.assign(_m=1.0), ["_m", value])
        found = candidates(grid > 0, val, spacing, ratios, percentiles, least_fragment, least_thickness, most_thickness, most_aspect, 0, peak_um)
        rows = [{**{c: pdf[c].iloc[0] for c in by}, "label": pdf["label"].iloc[0], "score": s, "size": n, "at": (at + low).ravel().tolist(), **dict(zip(("cz", "cy", "cx"), ((at + low).mean(axis=0) * np.array(spacing)).tolist(), strict=True))} for s, n, at in found]
        return pd.DataFrame(rows, columns=[*by, "label", "score", "size", "at", "cz", "cy", "cx"])

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        used, centres, out = set(), [], []
        rows = sorted(pdf.to_dict("records"), key=lambda r: (-r["score"], -r["size"], r["label"], list(r["at"])))
        for r in rows:
            at = np.array(r["at"]).reshape(-1, 3)
            centre = at.mean(axis=0) * np.array(spacing)
            if any((apart_within or name != r["label"]) and np.linalg.norm(centre - c) < separation_um for name, c in centres):
                continue
            voxels = set(map(tuple, at.tolist()))
            if used & voxels:
                continue
            used |= voxels
            centres.append((r["label"], centre))
            out.append({**{c: r[c] for c in by}, "label": r["label"], "score": r["score"], "size": r["size"], "at": r["at"]})
        return pd.DataFrame(out, columns=[*by, "label", "score", "size", "at"])

    found = staged(cells.select(*by, "label", *(F.col(a).cast("long").alias(a) for a in AXES), value).groupBy(*by, "label").applyInPandas(find, f"{schema}label {lab}, score double, size long, at array<long>, cz double, cy double, cx double"))
    grouped = found.withColumn("_group", F.col("label").cast("long"))
    if separation_um > 0:
        centres = ("cz", "cy", "cx")
        a = found.select(*by, F.col("label").alias("a"), *(F.col(c).alias(f"a{c}") for c in centres), *(F.floor(F.col(c) / separation_um).alias(f"_{c}") for c in centres))
        b = found.select(*by, F.col("label").alias("b"), *centres, *(F.floor(F.col(c) / separation_um).alias(f"_{c}") for c in centres))
        for c in centres:
            a = a.withColumn(f"_{c}", F.explode(F.array(*(F.col(f"_{c}") + d for d in (-1, 0, 1)))))
        apart = sum(((F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in centres), F.lit(0.0))
        near = a.join(b, [*by, *(f"_{c}" for c in centres)]).where(F.col("a") < F.col("b")).where(apart <= separation_um**2 * (1 + 1e-9))
        groups = connected_components(near.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()).select(F.col("node").alias("_group"), "component")
        grouped = grouped.join(groups, "_group", "left").withColumn("_group", F.coalesce("component", "_group")).drop("component")
    placed = staged(grouped.groupBy(*by, "_group").applyInPandas(place, f"{schema}label {lab}, score double, size long, at array<long>"))
    key = F.struct((-F.col("score")).alias("s"), (-F.col("size")).alias("n"), "label", "at")
    numbers = relabel(placed.select(*by, key.alias("_key")), "_key", "seed", tuple(by))
    voxel = F.transform(F.sequence(F.lit(0), F.floor(F.size("at") / 3) - 1), lambda k: F.struct(*(F.element_at("at", (k * 3 + d + 1).cast("int")).alias(a) for d, a in enumerate(AXES))))
    named = placed.withColumn("_key", key).join(numbers, [*by, "_key"])
    return named.select(*by, "label", "seed", F.explode(voxel).alias("_v")).select(*by, "label", "seed", *(F.col(f"_v.{a}").alias(a) for a in AXES))


def distance_core(cells: DataFrame, ratio: float, distance: str = "distance", by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Voxels whose distance is at least ``ratio`` of their object's greatest: maxima come from partial aggregates."""
    top = cells.groupBy(*by).agg(F.max(distance).alias("_top"))
    return cells.join(top, list(by)).where(F.col(distance) >= ratio * F.col("_top")).drop("_top")


def intensity_core(cells: DataFrame, p: float, value: str = "intensity", by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Voxels at or above the percentile p of their object's intensities."""
    level = cells.groupBy(*by).agg(F.percentile(value, p / 100).alias("_level"))
    return cells.join(level, list(by)).where(F.col(value) >= F.col("_level")).drop("_level")


def aspect_ratio(cells: DataFrame, spacing=(1.0, 1.0, 1.0), by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Per 2D object the square root of its coordinates' covariance eigenvalues' ratio; null for straight or tiny ones."""
    y, x = F.col("y") * F.lit(spacing[1]), F.col("x") * F.lit(spacing[2])
    m = cells.groupBy(*by).agg(F.var_samp(y).alias("a"), F.var_samp(x).alias("b"), F.covar_samp(y, x).alias("c"), F.count("*").alias("n"))
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, F.lit(2)) + F.col("c") * F.col("c"))
    low = half - root
    return m.select(*by, "n", F.when((F.col("n") > 2) & (low > 1e-9), F.sqrt((half + root) / low)).alias("aspect"))
