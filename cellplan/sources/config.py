"""Step configurations: parameters with values, kept as YAML; and the shipped defaults of each mode."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml

#: Values by mode and step. These are the parameters users know, with their usual settings.
DEFAULTS = {
    "3d": {
        "raw_segmentation": {"tubular_scales": [1.0, 1.5, 3.0], "min_size": 1000, "smooth_sigma": 0.2, "low_threshold_percentile": 95.0, "high_threshold_percentile": 100.0, "connect_max_gap_physical": 1.0, "subtract_background_radius": 0},
        "trim_edges": {"edge_trim_distance_threshold": 4.0, "brightness_cutoff_factor": 1_000_000.0, "min_size": 2000, "hull_closing_radius": 1, "z_erosion_iterations": 2},
        "extract_seeds": {"ratios_to_process": [0.3, 0.4, 0.5, 0.6], "intensity_percentiles_to_process": [99, 95, 90, 80, 70, 60, 50, 40, 30, 20, 10, 1], "min_fragment_size": 2500, "min_physical_peak_separation": 7.0, "seeding_min_distance_um": 1.0, "absolute_min_thickness_um": 1.5, "absolute_max_thickness_um": 10.0, "max_allowed_core_aspect_ratio": 10.0},
        "separate_cells": {"min_size": 20_000, "min_path_intensity_ratio": 0.6, "min_local_intensity_difference": 0.01, "local_analysis_radius": 10, "intensity_weight": 0.0},
        "calculate_features": {"prune_spurs_le_um": 6.0, "calculate_distances": True, "calculate_skeletons": True},
        "interaction": {"target_channel_folder": "", "calculate_distance": True, "calculate_overlap": True},
    },
    "2d": {
        "raw_segmentation": {"tubular_scales": [1.0], "min_size": 450, "smooth_sigma": 0.3, "low_threshold_percentile": 94.0, "high_threshold_percentile": 100.0, "connect_max_gap_physical": 0.0, "subtract_background_radius": 0},
        "trim_edges": {"edge_trim_distance_threshold": 0.0, "brightness_cutoff_factor": 1.5, "min_size": 120, "hull_closing_radius": 10, "z_erosion_iterations": 0},
        "extract_seeds": {"ratios_to_process": [0.3, 0.4, 0.5, 0.6], "intensity_percentiles_to_process": [99, 95, 90, 80, 70, 60, 50, 40, 30, 20, 10, 1], "min_fragment_size": 400, "min_physical_peak_separation": 20.0, "seeding_min_distance_um": 0.0, "absolute_min_thickness_um": 1.5, "absolute_max_thickness_um": 10.0, "max_allowed_core_aspect_ratio": 5.0},
        "separate_cells": {"min_size": 100, "min_path_intensity_ratio": 0.6, "min_local_intensity_difference": 0.01, "local_analysis_radius": 10, "intensity_weight": 0.5},
        "calculate_features": {"prune_spurs_le_um": 6.0, "calculate_distances": True, "calculate_skeletons": True},
        "interaction": {"target_channel_folder": "", "calculate_distance": True, "calculate_overlap": True},
    },
}


@dataclass
class Config:
    """mode, parameters by step, and the physical size of the whole image by axis (None: unknown)."""

    mode: str
    steps: dict[str, dict] = field(default_factory=dict)
    dimensions_um: dict[str, float | None] = field(default_factory=dict)
    saved_state: dict = field(default_factory=dict)

    @classmethod
    def default(cls, mode: str) -> Config:
        return cls(mode, {k: dict(v) for k, v in DEFAULTS[mode].items()})

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        """Steps may be given plainly, or with a ``parameters`` block whose entries hold ``value``; missing ones have defaults."""
        raw = yaml.safe_load(text) or {}
        out = cls.default(raw.get("mode", "3d"))
        for step, given in raw.items():
            if step in ("mode", "voxel_dimensions", "pixel_dimensions", "saved_state") or not isinstance(given, dict):
                continue
            values = {k: v["value"] if isinstance(v, dict) and "value" in v else v for k, v in given.get("parameters", given).items()}
            out.steps.setdefault(step, {}).update(values)
        out.dimensions_um = dict(raw.get("voxel_dimensions") or raw.get("pixel_dimensions") or {})
        out.saved_state = dict(raw.get("saved_state") or {})
        return out

    def to_yaml(self) -> str:
        key = "voxel_dimensions" if self.mode == "3d" else "pixel_dimensions"
        return yaml.safe_dump({"mode": self.mode, key: self.dimensions_um, **{s: {"parameters": {k: {"value": v} for k, v in p.items()}} for s, p in self.steps.items()}, "saved_state": self.saved_state}, sort_keys=False)

    def value(self, step: str, name: str):
        return self.steps.get(step, {}).get(name, DEFAULTS[self.mode][step].get(name))

    def spacing(self, shape: tuple[int, int, int]) -> tuple[float, float, float]:
        """Physical size of a voxel (z, y, x); an unknown total counts as 1; z is 1 in 2D."""
        sizes = [(self.dimensions_um.get(a) or 1.0) / n for a, n in zip("zyx", shape, strict=True)]
        return (1.0, sizes[1], sizes[2]) if self.mode == "2d" else tuple(sizes)
