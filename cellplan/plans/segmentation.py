"""The segmentation pipeline: ordered steps over one image's voxels, each artifact a Parquet table that a later run resumes from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import interaction, kernels, levels, measure, raster, seeds, trim
from ..operators.graph import connected_components
from ..operators.raster import AXES
from ..sources.config import Config

STEPS = ("raw_segmentation", "trim_edges", "extract_seeds", "separate_cells", "calculate_features", "interaction")


def raw_segmentation(voxels: DataFrame, config: Config, spacing) -> tuple[DataFrame, float]:
    """Labels (z, y, x, label) of the image's bright objects, numbered from 1, and the threshold that was used.

    voxels must cover the raster densely: enhancement and smoothing look at neighbours.
    """
    get = lambda name: config.value("raw_segmentation", name)
    dims = 3 if config.mode == "3d" else 2
    field = voxels.select(*AXES, F.col("intensity").alias("v"))
    if get("subtract_background_radius"):
        field = kernels.white_tophat(field, "v", get("subtract_background_radius"), to="v")
    scales = [s for s in get("tubular_scales") if s > 0]
    if scales:
        pixel = (spacing[1] + spacing[2]) / 2
        field = kernels.vesselness(field, "v", "both", [s / pixel for s in scales], to="v")
    if get("smooth_sigma") > 0:
        field = kernels.gaussian_smooth(field, "v", get("smooth_sigma"), spacing, dims, to="v")
    high = get("high_threshold_percentile")
    field = levels.z_profile_normalize(field, "v", high, to="v") if dims == 3 else levels.global_normalize(field, "v", high, to="v")
    threshold = levels.foreground_threshold(field, "v", get("low_threshold_percentile")).first()["threshold"]
    mask = field.where(F.col("v") > threshold).select(*AXES)
    gap = get("connect_max_gap_physical")
    if gap > 0:
        half = [max(0, -(-gap / 2 // s)) for s in spacing]
        box = [(int(z), int(y), int(x)) for z in range(-int(half[0]) if dims == 3 else 0, (int(half[0]) if dims == 3 else 0) + 1) for y in range(-int(half[1]), int(half[1]) + 1) for x in range(-int(half[2]), int(half[2]) + 1)]
        mask = raster.mask_or(mask, raster.close_gaps(mask, box)).join(voxels.select(*AXES), list(AXES), "left_semi")
    found = raster.size_filter(raster.components(raster.numbered(mask), dims=dims), get("min_size"))
    return raster.apply_lut(found, raster.relabel(found)).select(*AXES, "label"), float(threshold)


def trim_edges(labels: DataFrame, voxels: DataFrame, threshold: float, config: Config, spacing) -> tuple[DataFrame, DataFrame]:
    get = lambda name: config.value("trim_edges", name)
    return trim.trim(labels, voxels, threshold, get("edge_trim_distance_threshold"), get("brightness_cutoff_factor"), get("min_size"), spacing, "intensity", get("hull_closing_radius"), get("z_erosion_iterations"), 3 if config.mode == "3d" else 2)


def extract_seeds(labels: DataFrame, voxels: DataFrame, config: Config, spacing) -> DataFrame:
    get = lambda name: config.value("extract_seeds", name)
    cells = labels.join(voxels.select(*AXES, "intensity"), list(AXES))
    return seeds.extract_seeds(cells, "intensity", spacing, get("min_fragment_size"), get("min_physical_peak_separation"), get("absolute_min_thickness_um"), get("absolute_max_thickness_um"), get("max_allowed_core_aspect_ratio"), tuple(get("ratios_to_process")), tuple(get("intensity_percentiles_to_process")), get("seeding_min_distance_um"))


def separate_cells(labels: DataFrame, seeds_: DataFrame, voxels: DataFrame, config: Config, spacing) -> DataFrame:
    """Labels after splitting: cells of several seeds are flooded, segments whose border is bright or without contrast join again.

    Parts of a segment that hold no seed go to the segment that they border most, or are deleted below min_size (3D);
    then voids that one object encloses are filled (3D). One grouped map a cell floods it whole, so nothing is stitched.
    """
    get = lambda name: config.value("separate_cells", name)
    dims = 3 if config.mode == "3d" else 2
    cells = labels.join(voxels.select(*AXES, "intensity"), list(AXES)).join(seeds_.select(*AXES, "seed"), list(AXES), "left")
    parts = kernels.split_cells(cells, "intensity", get("intensity_weight"), spacing).withColumnRenamed("label", "cell").withColumnRenamed("segment", "label")
    parts = parts.join(voxels.select(*AXES, "intensity"), list(AXES))
    means = cells.where("seed is not null").groupBy(F.col("label").alias("cell"), F.col("seed").alias("label")).agg(F.avg("intensity").alias("mean"))
    metrics = interaction.interface_metrics(parts, means, get("min_path_intensity_ratio"), "intensity", dims=dims)
    contrast = interaction.local_contrast(parts, get("local_analysis_radius"), get("min_local_intensity_difference"), "intensity", dims=dims)
    joined = interaction.merge_decisions(metrics, contrast).where("should_merge")
    top = parts.agg(F.max("cell"), F.max("label")).first()
    if max(x or 0 for x in top) >= 1 << 31:
        raise ValueError("cells and seeds must be numbered below 2^31")
    node = lambda c: (F.col("cell") * (1 << 31) + F.col(c)).alias(c)
    roots = connected_components(joined.select(node("a"), node("b")))
    final = parts.withColumn("_n", F.col("cell") * (1 << 31) + F.col("label")).join(roots.withColumnRenamed("node", "_n"), "_n", "left").select("cell", *AXES, F.coalesce("component", "_n").alias("label"))
    marked = raster.numbered(final.join(seeds_.select(*AXES, "seed"), list(AXES), "left"))
    settled = interaction.settle_orphans(marked, get("min_size") if dims == 3 else 0, dims=dims).select(*AXES, "label")
    if dims == 3:
        settled = interaction.fill_voids(settled, raster.numbered(voxels.select(*AXES)), dims)
    return raster.apply_lut(settled, raster.relabel(settled)).select(*AXES, "label")


def calculate_features(labels: DataFrame, voxels: DataFrame, config: Config, spacing) -> DataFrame:
    """One row for each object: shape, depth, intensity, and if asked for nearest neighbour and skeleton."""
    get = lambda name: config.value("calculate_features", name)
    dims = 3 if config.mode == "3d" else 2
    tables = [measure.shape_3d(labels, spacing) if dims == 3 else measure.shape_2d(labels, spacing), measure.depth(labels, spacing[0] if dims == 3 else 0.0), measure.intensity(labels.join(voxels.select(*AXES, "intensity"), list(AXES)))]
    out = measure.merge_metrics(*tables)
    if get("calculate_distances"):
        near = measure.nearest_objects(labels, spacing, dims=dims, reach=8 * max(spacing)).select("label", "shortest_distance_um", "closest_neighbor_label")
        out = measure.merge_metrics(out, near, how="left")
    if get("calculate_skeletons"):
        skel = kernels.skeletonize(labels, spacing, get("prune_spurs_le_um"))
        length = skel.groupBy("label").agg(F.max("total_length").alias("skan_total_length_um"), F.max(F.when(F.col("n_paths") > 0, F.col("total_length") / F.col("n_paths"))).alias("skan_avg_branch_length_um"))
        out = measure.merge_metrics(out, measure.skeleton_counts(skel, dims=dims).join(length, "label"), how="left")
    return out


def interact(labels: DataFrame, reference: DataFrame, name: str, config: Config, spacing) -> tuple[DataFrame, DataFrame]:
    """Per primary object its overlap with and distance to another channel's objects, and per reference object its coverage."""
    dims = 3 if config.mode == "3d" else 2
    out = labels.select("label").distinct()
    if config.value("interaction", "calculate_overlap"):
        out = out.join(interaction.overlap_per_primary(labels, reference, name, spacing, dims=dims), "label", "left")
    if config.value("interaction", "calculate_distance"):
        out = out.join(interaction.distance_to_reference(labels, reference, name, spacing, dims=dims), "label", "left")
    return out, interaction.coverage(labels, reference, spacing, dims=dims)


@dataclass
class Run:
    """Runs the steps of one image below a folder that all executors share. Artifacts that are there are not made again."""

    spark: SparkSession
    root: str
    config: Config
    spacing: tuple[float, float, float]

    def _path(self, artifact: str) -> str:
        return f"{self.root}/{self.config.mode}/{artifact}"

    def present(self, artifact: str) -> bool:
        """Whether an artifact was written to its end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(artifact)}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def last_completed(self) -> int:
        done = [self.present(s) for s in STEPS]
        return done.index(False) if False in done else len(done)

    def discard_from(self, step: int) -> None:
        """Deletes the artifacts of a step (from 1) and of those after it."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in [*STEPS[step - 1 :], *(["edge_mask"] if step <= 2 else []), *(["coverage"] if step <= 6 else [])]:
            p = fs_path(self._path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def artifact(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def _keep(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self._path(name))

    def execute(self, voxels: DataFrame, reference: DataFrame | None = None, reference_name: str = "reference", restart: bool = False) -> list[tuple[str, str]]:
        """(step, status) for each step: done, kept (from before), skipped (no reference) or the error that ended the run."""
        if restart:
            self.discard_from(1)
        out = []
        for k, step in enumerate(STEPS, 1):
            if self.present(step):
                out.append((step, "kept"))
                continue
            if step == "interaction" and reference is None:
                out.append((step, "skipped"))
                continue
            self.discard_from(k)
            try:
                self._step(step, voxels, reference, reference_name)
            except Exception as e:  # the caller gets the status of every image
                out.append((step, f"failed: {e}"[:300]))
                break
            out.append((step, "done"))
        return out

    def _step(self, step: str, voxels: DataFrame, reference: DataFrame | None, name: str) -> None:
        c, s = self.config, self.spacing
        if step == "raw_segmentation":
            labels, threshold = raw_segmentation(voxels, c, s)
            self._keep(labels.withColumn("threshold", F.lit(threshold)), step)
        elif step == "trim_edges":
            raw = self.artifact("raw_segmentation")
            first = raw.select("threshold").first()
            trimmed, edge = trim_edges(raw.drop("threshold"), voxels, first["threshold"] if first else 0.0, c, s)
            self._keep(edge, "edge_mask")
            self._keep(trimmed, step)
        elif step == "extract_seeds":
            self._keep(extract_seeds(self.artifact("trim_edges"), voxels, c, s), step)
        elif step == "separate_cells":
            self._keep(separate_cells(self.artifact("trim_edges"), self.artifact("extract_seeds"), voxels, c, s), step)
        elif step == "calculate_features":
            self._keep(calculate_features(self.artifact("separate_cells"), voxels, c, s), step)
        else:
            per_object, covered = interact(self.artifact("separate_cells"), reference, name, c, s)
            self._keep(covered, "coverage")
            self._keep(per_object, step)


def run_all(images: dict[str, tuple[Run, DataFrame]], restart: bool = False, at_once: int = 4) -> dict[str, str]:
    """Runs every image; by image success, or the status of the step that failed.

    ``at_once`` images are submitted together, so that the cluster's scheduler fills its cores from several.
    """
    from concurrent.futures import ThreadPoolExecutor

    def one(item) -> tuple[str, str]:
        name, (run, voxels) = item
        steps = run.execute(voxels, restart=restart)
        return name, next((s for _, s in steps if s.startswith("failed")), "success")

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return dict(pool.map(one, images.items()))
