"""Intensity levels: percentiles, normalisation, thresholds, histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged

#: Tables that the optimiser bounds by so many bytes have their percentiles from one task.
MOST_BYTES = 256 << 20


def percentile(value: str | Column, p: float) -> Column:
    """The exact percentile (p in 0..100) with linear interpolation."""
    return F.percentile(value, p / 100)


def level(df: DataFrame, value: str, p: float, to: str = "level", most: int = MOST_BYTES) -> DataFrame:
    """One row: the exact percentile p of all rows, null without any.

    percentile() holds all distinct values in one task; so it is used only where the optimiser bounds df by ``most``
    bytes. Beyond that narrowed() finds the same number.
    """
    one = df.select(F.col(value).cast("double").alias("v"))
    size = int(str(one._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= most:
        return one.agg(percentile("v", p).alias(to))
    return df.sparkSession.createDataFrame([(narrowed(one, p),)], f"{to} double")


def narrowed(values: DataFrame, p: float, bins: int = 1024, few: int = 100_000) -> float | None:
    """percentile() of the one column v by histograms, each over one bin of the last, until a bin's rows are few.

    NaN counts as greater than all numbers, infinities by their sign. No task holds more than ``bins`` rows until then.
    """
    values = staged(values.where("v is not null"))
    n = values.count()
    if not n:
        return None
    rank = p / 100 * (n - 1)

    def at(i: int) -> float:
        part, before = values, 0
        while True:
            finite = part.where((F.abs("v") != math.inf) & ~F.isnan("v"))
            low, high = finite.agg(F.min("v"), F.max("v")).first()
            width = None if low is None or high == low else (high / bins - low / bins) or None
            place = F.least(F.lit(bins - 1.0), F.floor((F.col("v") - (low or 0.0)) / F.lit(width or 1.0))) if width else F.lit(0.0)
            bin_ = F.when(F.isnan("v"), bins + 1.0).when(F.col("v") == math.inf, float(bins)).when(F.col("v") == -math.inf, -1.0).otherwise(place)
            for _, m, a, b in sorted(part.groupBy(bin_.alias("bin")).agg(F.count("*"), F.min("v"), F.max("v")).collect()):
                if i < before + m:
                    break
                before += m
            if a == b or math.isnan(a):
                return a
            part = part.where((F.col("v") >= a) & (F.col("v") <= b))
            if m <= few:
                return sorted(r.v for r in part.collect())[i - before]

    below = at(math.floor(rank))
    return below if rank == math.floor(rank) else below + (rank - math.floor(rank)) * (at(math.floor(rank) + 1) - below)


def foreground_threshold(df: DataFrame, value: str, low: float, least_samples: int = 1000, floor: float = 1e-5) -> DataFrame:
    """One row (threshold, samples): the percentile of positive values; without enough of them so high that nothing passes."""
    positive = df.where(F.col(value) > 0)
    found = positive.agg(F.count("*").alias("samples")).join(F.broadcast(level(positive, value, low)))  # one row each
    return found.select(F.when(F.col("samples") > least_samples, F.greatest("level", F.lit(floor))).otherwise(F.lit(1e9)).alias("threshold"), "samples")


def above(df: DataFrame, value: str, p: float) -> DataFrame:
    """Rows whose value exceeds the percentile p of all rows."""
    return df.join(F.broadcast(level(df, value, p, "_t"))).where(F.col(value) > F.col("_t")).drop("_t")  # one row


def global_normalize(df: DataFrame, value: str, p: float, stride: int = 8, to: str = "normalized") -> DataFrame:
    """value over the percentile of a strided sample's positives, which is 1e-9 at least."""
    sample = df.where((F.col("y") % stride == 0) & (F.col("x") % stride == 0) & (F.col(value) > 0))
    scale = level(sample, value, p).select(F.greatest("level", F.lit(1e-9)).alias("_level"))
    return df.join(F.broadcast(scale)).withColumn(to, F.col(value) / F.col("_level")).drop("_level")  # one row


def z_profile(df: DataFrame, value: str, p: float) -> DataFrame:
    """Rows (z, level, fitted): each slice's percentile of positives and a parabola through them by least squares.

    fitted is at least the 10th percentile of the levels. Normal equations are solved from sums over slices (Cramer's rule).
    """
    levels = df.where(F.col(value) > 0).groupBy("z").agg(percentile(value, p).alias("level"))
    z, h = F.col("z").cast("double"), F.col("level")
    s = levels.agg(*(F.sum(z**k).alias(f"s{k}") for k in range(5)), *(F.sum(z**k * h).alias(f"t{k}") for k in range(3)), F.percentile("level", 0.1).alias("floor"))

    def det(m):
        (a, b, c), (d, e, f), (g, i, j) = m
        return a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)

    base = [[F.col(f"s{i + k}") for k in range(3)] for i in range(3)]
    t = [F.col(f"t{i}") for i in range(3)]
    solved = s.select("floor", det(base).alias("d"), *(det([[t[i] if k == c else base[i][k] for k in range(3)] for i in range(3)]).alias(f"d{c}") for c in range(3)))
    fit = F.try_divide(F.col("d0") + F.col("d1") * z + F.col("d2") * z * z, F.col("d"))
    return levels.join(F.broadcast(solved)).select("z", "level", F.greatest(F.coalesce(fit, h), F.col("floor")).alias("fitted"))  # one row


def z_profile_normalize(df: DataFrame, value: str, p: float, to: str = "normalized") -> DataFrame:
    factor = F.when(F.col("fitted") > 1e-9, F.col("fitted")).otherwise(1.0)
    return df.join(z_profile(df, value, p).select("z", "fitted"), "z", "left").withColumn(to, F.col(value) / F.coalesce(factor, F.lit(1.0))).drop("fitted")


def strided(df: DataFrame, **steps: int) -> DataFrame:
    """Every n-th voxel along the named axes."""
    for axis, n in steps.items():
        df = df.where(F.col(axis) % n == 0)
    return df


def every_kth(df: DataFrame, order: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows 1, k + 1, 2k + 1 ... in order (of each group). Without groups ``order`` must be unique: ranks then come from a range sort."""
    from .raster import relabel

    if by:
        ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    else:
        ranked = df.join(relabel(df, order, "_r"), order)
    return ranked.where(F.col("_r") % k == (1 if k > 1 else 0)).select(*df.columns)


def histogram(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """Rows (bin, n, low, high): counts of equal bins between the extremes; the last bin is closed. Rows of empty bins are absent."""
    span = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col(value) - F.col("low")) * bins, F.col("high") - F.col("low")), F.lit(0.0)))).cast("int")
    return df.join(F.broadcast(span)).groupBy(at.alias("bin"), "low", "high").agg(F.count("*").alias("n"))  # one row


def otsu(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """One row (threshold): the bin centre that maximises the variance between classes, the first on a tie. Null without rows."""
    h = histogram(df, value, bins)
    c = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / bins
    upto, all_ = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    sums = h.select("bin", c.alias("c"), F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * c).over(upto).alias("s0"), F.sum("n").over(all_).alias("n"), F.sum(F.col("n") * c).over(all_).alias("s"))  # at most ``bins`` rows
    between = F.col("n0") * (F.col("n") - F.col("n0")) * F.pow(F.try_divide(F.col("s0"), F.col("n0")) - F.try_divide(F.col("s") - F.col("s0"), F.col("n") - F.col("n0")), F.lit(2))
    return sums.withColumn("v", F.coalesce(between, F.lit(0.0))).agg(F.max_by("c", F.struct(F.round("v", 6), -F.col("bin"))).alias("threshold"))


def log_otsu_hull_level(df: DataFrame, value: str, bins: int = 256, factor: float = 0.8) -> DataFrame:
    """One row (threshold): Otsu on log1p of the positive values, scaled and taken back."""
    logs = df.where(F.col(value) > 0).select(F.log1p(value).alias("v"))
    return otsu(logs, "v", bins).select(F.expm1(F.col("threshold") * factor).alias("threshold"))


def reference_threshold(otsu_: Column, threshold: Column, highest: Column, factor: float) -> Column:
    """The brightness cutoff: Otsu where a threshold below 2 meets values above 5, else the threshold; times the factor."""
    return F.when((highest > 5) & (threshold < 2), otsu_).otherwise(threshold) * factor


def combine_responses(frangi: Column, sato: Column, intensity: Column, sigma_voxels: float) -> Column:
    """The greater response; at coarse scales (2 voxels or more) weighted by the intensity."""
    best = F.greatest(frangi, sato)
    return best * intensity if sigma_voxels >= 2 else best


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    """The normalised kernel of radius int(truncate * sigma + 0.5)."""
    r = int(truncate * sigma + 0.5)
    taps = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)] if sigma > 0 else [1.0]
    return [t / sum(taps) for t in taps]
