"""Cohort statistics over tables of measured cells: groups, replicates, tests, correlation, distributions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged
from .levels import level


def unpivot_groups(wide: DataFrame, batch: str, names: dict[str, str] | None = None) -> DataFrame:
    """Rows (Batch, Experimental_Group, Image_ID) of a table with a column of image ids for each group; nulls go, ids are trimmed."""
    groups = [c for c in wide.columns if c != batch]
    long = wide.unpivot([batch], groups, "Experimental_Group", "Image_ID").dropna(subset=["Image_ID"])
    group = F.col("Experimental_Group")
    if names:
        group = F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[group], group)
    return long.select(F.col(batch).alias("Batch"), group.alias("Experimental_Group"), F.trim("Image_ID").alias("Image_ID"))


def attach_groups(cells: DataFrame, groups: DataFrame, image: str = "Image_ID", tag: str = "cells") -> DataFrame:
    """Cells with Experimental_Group and Batch from the groups, where these have the image, else their own.

    If no cell has a group after that, all are in <tag>_DefaultGroup; a cell without batch has its image for one.
    """
    given = groups.select(F.col("Image_ID").alias("_id"), F.col("Experimental_Group").alias("_g"), F.col("Batch").cast("string").alias("_b"))
    out = cells.join(given, F.col(image) == F.col("_id"), "left")
    own = lambda c: F.col(c) if c in cells.columns else F.lit(None).cast("string")
    group, batch = F.coalesce("_g", own("Experimental_Group")), F.coalesce("_b", own("Batch").cast("string"), F.col(image).cast("string"))
    out = out.withColumn("_g", group).withColumn("_b", batch)
    any_group = out.agg(F.max(F.col("_g").isNotNull()).alias("_any"))
    out = out.join(F.broadcast(any_group))  # one row
    rest = [c for c in cells.columns if c not in ("Experimental_Group", "Batch")]
    return out.select(*rest, F.when(F.coalesce("_any", F.lit(False)), F.col("_g")).otherwise(F.lit(f"{tag}_DefaultGroup")).alias("Experimental_Group"), F.col("_b").alias("Batch"))


def union_cohorts(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def two_level_mean(cells: DataFrame, metrics: list[str], image: str, batch: str, group: str) -> DataFrame:
    """Mean over a replicate's images of the images' means. Rows with a null image, batch or group take no part."""
    used = [m for m in metrics if m in cells.columns]
    known = cells.dropna(subset=[image, batch, group])
    images = known.groupBy(image, batch, group).agg(*(F.avg(m).alias(m) for m in used))
    return images.groupBy(batch, group).agg(*(F.avg(m).alias(m) for m in used))


def cells_per_image(cells: DataFrame, image: str, batch: str, group: str) -> DataFrame:
    """Per replicate the mean number of cells in its images."""
    return cells.dropna(subset=[image, batch, group]).groupBy(image, batch, group).count().groupBy(batch, group).agg(F.avg("count").alias("Cell_Count"))


def replicates(cells: DataFrame, metrics: list[str], image: str, batch: str, group: str) -> DataFrame:
    return two_level_mean(cells, metrics, image, batch, group).join(cells_per_image(cells, image, batch, group), [batch, group])


def long_metrics(df: DataFrame, metrics: list[str], *keys: str) -> DataFrame:
    """Rows (keys, metric, value): only metrics that exist; values are doubles, nulls and NaN left out."""
    used = [m for m in metrics if m in df.columns]
    doubles = df.select(*keys, *(F.col(m).cast("double").alias(m) for m in used))
    return doubles.unpivot(list(keys), used, "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def _moments(df: DataFrame, metrics: list[str], group: str, groups: list | None) -> DataFrame:
    long = long_metrics(df, metrics, group).where(F.col(group).isNotNull())
    if groups is not None:
        long = long.where(F.col(group).isin(groups))
    return long.groupBy("metric", group).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))


def welch(df: DataFrame, metrics: list[str], group: str, groups: list | None = None) -> DataFrame:
    """Rows (metric, group_a, group_b, statistic, df) for every pair of groups with two values each and some variance."""
    s = _moments(df, metrics, group, groups).where("n >= 2")
    a, b = (s.select("metric", F.col(group).alias(f"group_{x}"), *(F.col(c).alias(f"{c}{x}") for c in "nmv")) for x in "ab")
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    freedom = F.try_divide((ea + eb) * (ea + eb), ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1))
    return a.join(b, "metric").where("group_a < group_b").select("metric", "group_a", "group_b", F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(ea + eb)).alias("statistic"), freedom.alias("df"))


def anova(df: DataFrame, metrics: list[str], group: str, groups: list | None = None) -> DataFrame:
    """Rows (metric, groups, statistic, df_between, df_within); null statistic unless every group has two values."""
    s = _moments(df, metrics, group, groups)
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    t = s.groupBy("metric").agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.sum("n").alias("n"), grand.alias("g"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    ok = (F.col("least") >= 2) & (F.col("groups") >= 2)
    between = F.col("q") - F.col("n") * F.col("g") * F.col("g")
    return t.select("metric", "groups", F.when(ok, F.try_divide(between / (F.col("groups") - 1), F.col("within") / (F.col("n") - F.col("groups")))).alias("statistic"), (F.col("groups") - 1).alias("df_between"), (F.col("n") - F.col("groups")).alias("df_within"))


def run_tests(df: DataFrame, metrics: list[str], group: str, dataset: str, groups: list | None = None) -> DataFrame:
    """One row for each metric: Welch's t-test with two groups, one-way ANOVA with more; statistic to 3 decimals, p-value."""
    from ..functions.stats import f_test_p, t_test_p
    from ..functions.columns import axis_label

    names = _moments(df, metrics, group, groups).groupBy("metric").agg(F.array_join(F.sort_array(F.collect_set(F.col(group).cast("string"))), " vs ").alias("Comparison"), F.count("*").alias("k"))
    t, f = welch(df, metrics, group, groups), anova(df, metrics, group, groups)
    both = names.join(t.select("metric", F.col("statistic").alias("t"), "df"), "metric", "left").where("k = 2 or t is null or k > 2").dropDuplicates(["metric"]).join(f, "metric", "left")
    two = F.col("k") == 2
    return both.select(
        F.lit(dataset).alias("Dataset"), axis_label(F.col("metric")).alias("Metric"), F.col("metric").alias("Raw_Metric"), "Comparison",
        F.when(two, "Welch t-test").otherwise("One-way ANOVA").alias("Test"),
        F.round(F.when(two, F.col("t")).otherwise(F.col("statistic")), 3).alias("Statistic"),
        F.when(two, t_test_p("t", "df")).otherwise(f_test_p("statistic", "df_between", "df_within")).alias("P_Value"),
    )


def bonferroni(results: DataFrame, p: str = "P_Value", by: tuple[str, ...] = (), alpha: float = 0.05) -> DataFrame:
    """Adds P_Value_Corrected and Significant_After_Correction; the family is the group's non-null p-values."""
    m = F.count(p).over(Window.partitionBy(*by))
    corrected = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * m))
    return results.withColumn("P_Value_Corrected", corrected).withColumn("Significant_After_Correction", F.coalesce(F.col("P_Value_Corrected") < alpha, F.lit(False)))


def uncorrected(results: DataFrame, p: str = "P_Value", alpha: float = 0.05) -> DataFrame:
    return results.withColumn("P_Value_Corrected", F.col(p)).withColumn("Significant_After_Correction", F.coalesce(F.col(p) < alpha, F.lit(False)))


def correlation_matrix(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows (metric_a, metric_b, r): Pearson over rows where both are known, all pairs in one pass."""
    used = [m for m in metrics if m in df.columns]
    clean = df.select(*(F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(m) for m in used))
    pairs = list(combinations_with_replacement(used, 2))
    row = clean.agg(*(F.corr(a, b).alias(f"{k}") for k, (a, b) in enumerate(pairs)))
    both = [(a, b, k) for k, (a, b) in enumerate(pairs)] + [(b, a, k) for k, (a, b) in enumerate(pairs) if a != b]
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"{k}").alias("r")) for a, b, k in both))).alias("e")).select("e.*")


def box_stats(df: DataFrame, metric: str, group: str) -> DataFrame:
    """Per group n, quartiles, upper whisker (q75 + 1.5 IQR, q75 itself without spread) and maximum."""
    known = df.dropna(subset=[metric, group])
    q = known.groupBy(group).agg(F.count("*").alias("n"), F.percentile(metric, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(metric).alias("highest"))
    q25, q50, q75 = (F.col("q")[k] for k in range(3))
    return q.select(group, "n", q25.alias("q25"), q50.alias("median"), q75.alias("q75"), F.when(q75 > q25, q75 + 1.5 * (q75 - q25)).otherwise(q75).alias("upper_whisker"), "highest")


def group_sizes(df: DataFrame, group: str, groups: DataFrame) -> DataFrame:
    """Rows of each listed group, 0 for those without any."""
    return groups.select(group).distinct().join(df.groupBy(group).agg(F.count("*").alias("n")), group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n"))


def density_histogram(df: DataFrame, metric: str, group: str, width: float = 1.0, least_top: float = 10.0) -> DataFrame:
    """Rows (group, bin, density): bins of ``width`` from 0 to the larger of ``least_top`` and the ceiled 99th percentile.

    The last bin holds its upper edge too; values outside don't count; densities of a group integrate to 1.
    """
    top = level(df, metric, 99).select(F.greatest(F.lit(least_top), F.ceil("level").cast("double")).alias("_top"))
    bins = F.ceil(F.col("_top") / width)
    within = df.dropna(subset=[metric, group]).join(F.broadcast(top)).where((F.col(metric) >= 0) & (F.col(metric) <= F.col("_top")))  # one row
    counts = within.groupBy(group, F.least(bins - 1, F.floor(F.col(metric) / width)).alias("bin")).agg(F.count("*").alias("n"))
    return counts.select(group, F.col("bin").cast("long"), (F.col("n") / (F.sum("n").over(Window.partitionBy(group)) * width)).alias("density"))


def significance_lookup(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (Dataset, Raw_Metric ...) with its p-values, where there are any."""
    return wanted.join(results.select("Dataset", "Raw_Metric", "P_Value", "P_Value_Corrected"), ["Dataset", "Raw_Metric"], "left")


def final_table(results: DataFrame, columns: list[str], numeric: tuple[str, ...] = ("Statistic", "P_Value", "P_Value_Corrected")) -> DataFrame:
    """The named columns that exist; what is no number in a numeric one becomes null."""
    return results.select(*((F.col(c).try_cast("double") if c in numeric else F.col(c)).alias(c) for c in columns if c in results.columns))


def _parts(name: Column, sizes: list[int]) -> Column:
    """All substrings of a name that have one of the lengths."""
    one = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(name) - n + 1)), lambda k: F.substring(name, k, F.lit(n)))
    return F.array_distinct(F.filter(F.flatten(F.array(*(F.when(F.length(name) >= n, one(n)).otherwise(F.array().cast("array<string>")) for n in sizes))), lambda x: F.length(x) > 0))


def containing(inner: DataFrame, outer: DataFrame, a: str, b: str, gram: int = 8) -> DataFrame:
    """Rows (a, b): distinct names a of inner that names b of outer contain, without comparing all pairs.

    A name meets only the names that hold its last ``gram`` letters (the whole of a shorter one): an equi-join on
    substrings. The empty name is in every name.
    """
    end = F.when(F.length(a) > gram, F.substring(F.col(a), -gram, gram)).otherwise(F.col(a))
    ends = inner.where(F.length(a) > 0).select(a, end.alias("_part"))
    sizes = sorted(r[0] for r in ends.select(F.length("_part")).distinct().collect())  # at most ``gram`` of them
    if not sizes:
        met = inner.where("false").join(outer)
    else:
        met = ends.join(outer.select(b, F.explode(_parts(F.col(b), sizes)).alias("_part")), "_part").where(F.contains(F.col(b), F.col(a))).select(a, b)
    first = outer.agg(F.min(b).alias(b)).where(F.col(b).isNotNull())  # of the empty name only the first container is of use
    return met.unionByName(inner.where(F.length(a) == 0).join(F.broadcast(first)))  # one row


def fuzzy_match(wanted: DataFrame, files: DataFrame, name: Column, file: Column, w: str = "wanted", f: str = "file") -> DataFrame:
    """Rows (w, f): each wanted name's file: the equal one, else the first by name that contains it or that it contains.

    The exact part is an equi-join; names left over meet the distinct file names by shared substrings. Null names take
    no part.
    """
    a = wanted.select(name.alias(w)).where(F.col(w).isNotNull()).distinct()
    b = staged(files.select(file.alias(f)).where(F.col(f).isNotNull()).distinct())
    both = staged(a.join(b, F.col(w) == F.col(f), "left"))
    exact, left = both.where(F.col(f).isNotNull()), both.where(F.col(f).isNull()).select(w)
    inside = containing(b.where(F.length(f) > 0), left, f, w).select(w, f).unionByName(left.join(F.broadcast(b.where(F.length(f) == 0))))  # one row
    rest = containing(left, b, w, f).unionByName(inside).groupBy(w).agg(F.min(f).alias(f))
    return exact.unionByName(rest)


def resume_point(checkpoints: DataFrame, steps: int) -> DataFrame:
    """Per image the last step before the first that lacks an artifact: rows (image_id, last_completed)."""
    whole = checkpoints.groupBy("image_id", "step").agg(F.min(F.col("present").cast("int")).alias("ok"))
    grid = checkpoints.select("image_id").distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    gap = grid.join(whole, ["image_id", "step"], "left").where(F.coalesce("ok", F.lit(0)) == 0).groupBy("image_id").agg(F.min("step").alias("gap"))
    return checkpoints.select("image_id").distinct().join(gap, "image_id", "left").select("image_id", (F.coalesce("gap", F.lit(steps + 1)) - 1).alias("last_completed"))
